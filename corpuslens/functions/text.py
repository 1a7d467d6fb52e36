"""Column helpers for text: lines, masking, counting, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import patterns as P

NL = "\n"
SPACE = " \t\n\r\f\x0b"


def decode_lenient(content: Column) -> Column:
    """Bytes to text; malformed UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", NL)


def newline_count(text: Column) -> Column:
    without = F.replace(text, F.lit(NL), F.lit(""))
    return (F.octet_length(text) - F.octet_length(without)).cast("bigint")


def source_lines(source: Column) -> Column:
    """Lines of a text; a final newline does not open another line."""
    return F.when(source == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(source, r"\n\z", ""), NL, -1)
    )


def line_span(lines: Column, start: Column, end: Column) -> Column:
    """Text of lines start..end (1-indexed, inclusive)."""
    first = F.greatest(start, F.lit(1)).cast("int")
    count = F.greatest(end - start + 1, F.lit(0)).cast("int")
    return F.array_join(F.slice(lines, first, count), NL)


def mask_code(text: Column) -> Column:
    """Comments and literals replaced by a space each; for counting only."""
    return F.regexp_replace(text, P.MASK, " ")


def html_safe(text: Column) -> Column:
    # The five escaped characters; '&' has to go first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def directory_of(path: Column) -> Column:
    """Path without its last segment; '' for a bare file name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def path_sort_key(path: Column) -> Column:
    """Plain string order of this key equals component-wise path order."""
    return F.replace(path, F.lit("/"), F.lit("\x01"))


def token_estimate(length: Column) -> Column:
    """Offline token estimate from a text length: a quarter of it, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(length / 4))


def matches_with_line(text: Column, pattern: str, first_line: Column) -> Column:
    """array<struct<text, line>> of all matches; line is absolute (1-indexed).

    A match's line is the start line plus the newlines in all segments up to it
    and in all earlier matches. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        found.alias("hit"),
    )
    start = F.struct(
        first_line.cast("bigint").alias("line"),
        F.expr("cast(array() as array<struct<text:string,line:bigint>>)").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        line = state["line"] + newline_count(piece["gap"])
        return F.when(
            piece["hit"].isNotNull(),
            F.struct(
                (line + newline_count(piece["hit"])).alias("line"),
                F.array_append(
                    state["out"], F.struct(piece["hit"].alias("text"), line.alias("line"))
                ).alias("out"),
            ),
        ).otherwise(state)

    return F.when(
        F.regexp_like(text, F.lit(pattern)), F.aggregate(pieces, start, step, lambda s: s["out"])
    ).otherwise(F.expr("cast(array() as array<struct<text:string,line:bigint>>)"))
