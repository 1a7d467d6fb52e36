"""Source text to declaration rows, with built-in expressions only.

A file is one row and stays one row until its declarations are known: nothing is
shuffled, and the text leaves the plan before the first exchange.

1. ``chunks``: the text cut at '{' and '}' by one regex in which comments, literals and
   annotations are atoms.
2. ``spans``: one fold over the chunks with a stack of open blocks. It yields the blocks
   that may be declarations (type headers, and anything with parentheses directly inside
   a type body) with their end line and enclosing type, and the chunks of type bodies
   that may hold methods without a body.
3. ``decls``: only these chunks are cut into statements and matched against the header
   patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import patterns as P
from corpuslens.functions.durable import computed_once, let
from corpuslens.functions.text import (
    SPACE,
    blank_to_null,
    line_span,
    newline_count,
    normalize_newlines,
    source_lines,
    trim_space,
)
from corpuslens.operators.metrics import CYCLOMATIC_LIMIT, LOC_LIMIT, cyclomatic, high_complexity
from corpuslens.operators.scans import text_findings

SPAN = "struct<idx:int,line:bigint,off:bigint,end_line:bigint,is_type:boolean,owner:int>"
BLOCK = "struct<idx:int,line:bigint,off:bigint,is_type:boolean,owner:int>"
CANDIDATE = (
    "struct<idx:int,line:bigint,off:bigint,end_line:bigint,is_type:boolean,owner:int,text:string>"
)
ORD_BITS = 28  # type_ord = file_ord << 28 | rank in file: a 2 GB text holds fewer types


def _bare(text: Column) -> Column:
    """``text``, read more than once here, without comments and outer whitespace."""
    return trim_space(F.when(F.contains(text, F.lit("/")), F.regexp_replace(text, P.COMMENT, " ")).otherwise(text))


def _statements(chunk: Column) -> Column:
    """Statements of a chunk; the empty match at its end comes last."""
    return F.regexp_extract_all(chunk, F.lit(P.STATEMENT), F.lit(0))


def _last_statement(chunk: Column) -> Column:
    """The last statement of a chunk. Its only brace is its end, so without a ';' it is one statement."""
    last = let(_statements(chunk), lambda s: F.coalesce(F.get(s, F.size(s) - 2), F.lit("")))
    return F.when(F.contains(chunk, F.lit(";")), last).otherwise(chunk)


def _chunk_facts(chunk: Column, idx: Column) -> Column:
    """What the fold needs to know of a chunk, computed once per chunk."""
    opens = F.endswith(chunk, F.lit("{"))
    header = let(F.regexp_replace(_last_statement(chunk), P.DECL_PREFIX, ""), _bare)
    is_type = (
        opens
        & F.regexp_like(chunk, F.lit(P.TYPE_HINT))
        & F.regexp_like(header, F.lit(P.TYPE_HEADER))
    )
    paren = F.contains(chunk, F.lit("("))
    return F.struct(
        idx.cast("int").alias("idx"),
        opens.alias("opens"),
        F.endswith(chunk, F.lit("}")).alias("closes"),
        newline_count(chunk).alias("nl"),
        F.octet_length(chunk).cast("bigint").alias("len"),
        is_type.alias("is_type"),
        paren.alias("paren"),
        (paren & F.contains(chunk, F.lit(";"))).alias("listed"),
    )


def _block_spans(facts: Column) -> Column:
    """struct<line, off, top, open, spans, underflow> after all chunks.

    ``top`` is the innermost open block, ``open`` the ones around it. A step builds its state
    without binding any of it again, which would copy all spans so far.

    A span with an end line is a block; one without is a chunk of a type body whose
    statements may declare methods. Offsets count the bytes of the text.
    """
    start = F.struct(
        F.lit(1).cast("bigint").alias("line"),
        F.lit(0).cast("bigint").alias("off"),
        F.expr(f"cast(null as {BLOCK})").alias("top"),
        F.expr(f"cast(array() as array<{BLOCK}>)").alias("open"),
        F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"),
        F.lit(False).alias("underflow"),
    )

    def step(state: Column, chunk: Column) -> Column:
        top, outer = state["top"], F.size(state["open"])
        inside = top.isNotNull()
        in_type = F.coalesce(top["is_type"], F.lit(False))
        candidate = chunk["is_type"] | (in_type & chunk["paren"])
        end_line = state["line"] + chunk["nl"]
        owner = F.when(in_type, top["idx"]).otherwise(F.lit(-1))
        opened = F.struct(
            F.when(candidate, chunk["idx"]).otherwise(F.lit(-1)).alias("idx"),
            state["line"].alias("line"),
            state["off"].alias("off"),
            chunk["is_type"].alias("is_type"),
            owner.alias("owner"),
        )
        closed = F.struct(
            top["idx"].alias("idx"),
            top["line"].alias("line"),
            top["off"].alias("off"),
            end_line.alias("end_line"),
            top["is_type"].alias("is_type"),
            top["owner"].alias("owner"),
        )
        listed = F.struct(
            chunk["idx"].alias("idx"),
            state["line"].alias("line"),
            state["off"].alias("off"),
            F.lit(None).cast("bigint").alias("end_line"),
            F.lit(False).alias("is_type"),
            owner.alias("owner"),
        )
        with_list = F.when(
            in_type & chunk["listed"], F.array_append(state["spans"], listed)
        ).otherwise(state["spans"])
        return F.struct(
            end_line.alias("line"),
            (state["off"] + chunk["len"]).alias("off"),
            F.when(chunk["opens"], opened)
            .when(chunk["closes"], F.get(state["open"], outer - 1))
            .otherwise(top)
            .alias("top"),
            F.when(chunk["opens"] & inside, F.array_append(state["open"], top))
            .when(chunk["closes"] & (outer > 0), F.slice(state["open"], F.lit(1), outer - 1))
            .otherwise(state["open"])
            .alias("open"),
            F.when(
                chunk["closes"] & (top["idx"] >= 0), F.array_append(with_list, closed)
            )
            .otherwise(with_list)
            .alias("spans"),
            (state["underflow"] | (chunk["closes"] & ~inside)).alias("underflow"),
        )

    return F.aggregate(facts, start, step)


def _candidates(spans: Column, chunks: Column) -> Column:
    """array<CANDIDATE>: the statement heading each block, and the statements of lists."""

    def of_block(span: Column, chunk: Column, head: Column) -> Column:
        before = (F.octet_length(chunk) - F.octet_length(head)).cast("bigint")
        lines_before = F.when(before == 0, before).otherwise(newline_count(chunk) - newline_count(head))
        return F.array(
            F.struct(
                span["idx"].alias("idx"),
                (span["line"] + lines_before).alias("line"),
                (span["off"] + before).alias("off"),
                span["end_line"].alias("end_line"),
                span["is_type"].alias("is_type"),
                span["owner"].alias("owner"),
                head.alias("text"),
            )
        )

    def declares(text: Column) -> Column:
        return F.endswith(text, F.lit(";")) & F.contains(text, F.lit("("))

    def of_list(span: Column, statements: Column) -> Column:
        start = F.struct(
            span["line"].alias("line"),
            span["off"].alias("off"),
            F.expr(f"cast(array() as array<{CANDIDATE}>)").alias("out"),
        )

        def step(state: Column, text: Column) -> Column:
            end_line = state["line"] + newline_count(text)
            declared = F.struct(
                span["idx"].alias("idx"),
                state["line"].alias("line"),
                state["off"].alias("off"),
                end_line.alias("end_line"),
                F.lit(False).alias("is_type"),
                span["owner"].alias("owner"),
                text.alias("text"),
            )
            return F.struct(
                end_line.alias("line"),
                (state["off"] + F.octet_length(text)).alias("off"),
                F.when(declares(text), F.array_append(state["out"], declared))
                .otherwise(state["out"])
                .alias("out"),
            )

        return F.when(
            F.exists(statements, declares), F.aggregate(statements, start, step, lambda s: s["out"])
        ).otherwise(F.expr(f"cast(array() as array<{CANDIDATE}>)"))

    def of_span(span: Column) -> Column:
        return let(
            F.get(chunks, span["idx"]),
            lambda chunk: F.when(
                span["end_line"].isNotNull(),
                let(_last_statement(chunk), lambda head: of_block(span, chunk, head)),
            ).otherwise(let(_statements(chunk), lambda statements: of_list(span, statements))),
        )

    return F.flatten(F.transform(spans, of_span))


def _doc_comments(source: Column) -> Column:
    """array<struct<end, text>>: raw doc comments with the offset, in bytes, just behind each."""
    pieces = F.arrays_zip(
        F.split(source, P.DOC_COMMENT, -1).alias("gap"),
        F.regexp_extract_all(source, F.lit(P.DOC_COMMENT), F.lit(0)).alias("hit"),
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("off"),
        F.expr("cast(array() as array<struct<end:bigint,text:string>>)").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        end = state["off"] + F.octet_length(piece["gap"]) + F.octet_length(piece["hit"])
        return F.when(
            piece["hit"].isNotNull(),
            F.struct(
                end.alias("off"),
                F.array_append(
                    state["out"], F.struct(end.alias("end"), piece["hit"].alias("text"))
                ).alias("out"),
            ),
        ).otherwise(state)

    return F.aggregate(pieces, start, step, lambda s: s["out"])


DOC_GAP = 200  # fixed value: characters that may lie between a doc comment and its declaration
GAP_LOOK = 4096  # bytes that mostly show a gap to be longer


def _gap_fits(source: Column, start: Column, size: Column) -> Column:
    """Whether ``size`` bytes from ``start`` are at most DOC_GAP characters, outer whitespace apart."""

    def exceeds(length: Column) -> Column:
        text = F.substring(source, (start + 1).cast("int"), length.cast("int")).cast("string")
        behind = F.substring(F.ltrim(text, F.lit(SPACE)), F.lit(DOC_GAP + 1), length.cast("int"))
        return F.regexp_like(behind, F.lit(r"\S"))

    look = F.least(size, F.lit(GAP_LOOK).cast("bigint"))
    return (size <= DOC_GAP) | (~exceeds(look) & ((size <= GAP_LOOK) | ~exceeds(size)))


def doc_before(source: Column, docs: Column, offset: Column) -> Column:
    """Cleaned text of the last doc comment ending at or before ``offset``.

    Null where more than 200 characters (outer whitespace apart) lie between. ``source``
    holds the bytes of the text, which offsets count: a place is reached without decoding
    what stands before it.
    """
    last = F.try_element_at(F.filter(docs, lambda d: d["end"] <= offset), F.lit(-1))

    def text_of(doc: Column) -> Column:
        inner = F.regexp_extract(doc["text"], r"(?s)\A/\*\*(.*)\*/\z", 1)
        cleaned = trim_space(F.regexp_replace(inner, r"(?md)^\s*\*\s?", ""))
        return F.when(_gap_fits(source, doc["end"], offset - doc["end"]), let(cleaned, blank_to_null))

    return let(last, text_of)


def _annotations(prefix: Column) -> Column:
    """array<struct<name, arguments>> of the annotations in a declaration's prefix."""
    found = F.filter(
        F.regexp_extract_all(prefix, F.lit(f"{P.COMMENT}|{P.ANNOTATION}"), F.lit(0)),
        lambda a: F.startswith(a, F.lit("@")),
    )
    return F.transform(
        found,
        lambda a: F.struct(
            F.regexp_extract(a, P.ANNOTATION_PARTS, 1).alias("name"),
            annotation_arguments(F.regexp_extract(a, P.ANNOTATION_PARTS, 2)).alias("arguments"),
        ),
    )


def annotation_arguments(args: Column) -> Column:
    """'(a = "x", b = 1)' to ['a=x', 'b=1']; '("x")' to ['x']; '()' and '' to []."""
    bare = trim_space(F.regexp_replace(F.regexp_replace(args, r"^\s*\(", ""), r"\)\s*$", ""))
    value = rf'(?:{P.STRING}|{P.CHAR}|\{{[^}}]*+\}}|\((?:[^()"]++|{P.STRING})*+\)|[^,"\'{{(]++)++'
    pair = rf"[\w$]++\s*+=(?!=){value}"

    def clean(text: Column) -> Column:
        return F.regexp_replace(trim_space(text), r'^"+|"+$', "")

    def listed(inner: Column) -> Column:
        named = F.transform(
            F.regexp_extract_all(inner, F.lit(pair), F.lit(0)),
            lambda p: F.concat(
                F.regexp_extract(p, r"^([\w$]+)", 1),
                F.lit("="),
                clean(F.regexp_replace(p, r"^[\w$]+\s*=", "")),
            ),
        )
        return (
            F.when(inner == "", F.array().cast("array<string>"))
            .when(F.regexp_like(inner, F.lit(r"^[\w$]+\s*=(?!=)")), named)
            .otherwise(F.array(clean(inner)))
        )

    return let(bare, listed)


def _without_generics(text: Column) -> Column:
    """Text, read more than once here, outside angle brackets, however deep they nest; unbalanced text stays as it is."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        depth, outside = state["depth"], state["depth"] == 0
        return F.struct(
            F.when(piece == "<", depth + 1).when((piece == ">") & ~outside, depth - 1).otherwise(depth).alias("depth"),
            F.when(~outside, state["out"])
            .otherwise(F.concat(state["out"], F.when(piece == "<", F.lit(" ")).otherwise(piece)))
            .alias("out"),
        )

    pieces = F.regexp_extract_all(text, F.lit(r"[<>]|[^<>]++"), F.lit(0))
    folded = F.aggregate(pieces, start, step, lambda s: F.when(s["depth"] == 0, s["out"]).otherwise(text))
    return F.when(F.contains(text, F.lit("<")), folded).otherwise(text)


def _parameters(text: Column) -> Column:
    """'final Long id, String... xs' to ['Long id', 'String xs'] (base type names)."""
    plain = F.regexp_replace(text, r"\bfinal\b|\.\.\.|\[\s*\]", " ")
    listed = F.filter(
        F.transform(
            F.split(plain, ","),
            lambda p: F.regexp_replace(
                trim_space(p), r"(?U)^([\w$]+)(?:\s*\.\s*[\w$]+)*\s+([\w$]+)$", "$1 $2"
            ),
        ),
        lambda p: p != "",
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(listed)


NO_ANNOTATIONS = "cast(array() as array<struct<name:string,arguments:array<string>>>)"


def _header_fields(is_type: Column, core: Column) -> Column:
    """struct<kind, name, type_name, params>, each '' where the text is no such header.

    One match per header: its groups are written out between NULs and split again.
    """
    method = F.split(F.regexp_replace(core, P.METHOD_HEADER, "$1\0$2\0$3"), "\0", -1)
    type_ = F.split(F.regexp_replace(core, P.TYPE_HEADER + "(?s:.*)$", "$1\0$2"), "\0", -1)

    def take(parts: Column, size: int, at: int) -> Column:
        return F.when(F.size(parts) == size, F.get(parts, F.lit(at))).otherwise("")

    def fields(parts: Column) -> Column:
        return F.struct(
            F.when(is_type, take(parts, 2, 0)).otherwise("").alias("kind"),
            F.when(is_type, take(parts, 2, 1)).otherwise(take(parts, 3, 1)).alias("name"),
            F.when(is_type, "").otherwise(take(parts, 3, 0)).alias("type_name"),
            F.when(is_type, "").otherwise(take(parts, 3, 2)).alias("params"),
        )

    return let(F.when(is_type, type_).otherwise(method), fields)


def _describe(candidates: Column, lines: Column) -> Column:
    """Candidates' header text to its parts; ``name`` is '' where it is no declaration.

    A block's end counts braces from the start of the declaration's line. That is the
    end of the block itself unless other braces stand before it on that line; only then
    are the lines counted again.
    """

    def cut(span: Column) -> Column:
        return F.struct(
            span.alias("span"), F.regexp_extract(span["text"], P.DECL_PREFIX, 0).alias("prefix")
        )

    def plain(is_type: Column, core: Column) -> Column:
        listed = let(F.regexp_replace(core, P.ANNOTATION, " "), lambda text: trim_space(_without_generics(text)))
        as_is = is_type | ~(F.contains(core, F.lit("@")) | F.contains(core, F.lit("<")))
        return F.when(as_is, core).otherwise(listed)

    def clean(c: Column) -> Column:
        text = c["span"]["text"]
        core = let(F.substring(text, F.length(c["prefix"]) + 1, F.octet_length(text)), _bare)
        return F.struct(
            c["span"].alias("span"),
            c["prefix"].alias("prefix"),
            (c["span"]["line"] + newline_count(c["prefix"])).alias("start_line"),
            let(core, lambda bare: plain(c["span"]["is_type"], bare)).alias("core"),
        )

    def part(c: Column) -> Column:
        return let(_header_fields(c["span"]["is_type"], c["core"]), lambda h: fields(c, h))

    def fields(c: Column, header: Column) -> Column:
        span, prefix = c["span"], c["prefix"]
        line_head = F.substring_index(prefix, "\n", -1)
        first_on_line = (F.contains(prefix, F.lit("\n")) | (span["off"] == 0)) & ~F.regexp_like(
            line_head, F.lit("[{};]")
        )
        noted = F.contains(prefix, F.lit("@"))
        words = F.when(
            noted | F.contains(prefix, F.lit("/")),
            F.regexp_replace(prefix, f"{P.COMMENT}|{P.ANNOTATION}", " "),
        ).otherwise(prefix)
        return F.struct(
            span["idx"].alias("idx"),
            span["is_type"].alias("is_type"),
            span["owner"].alias("owner"),
            (noted & F.startswith(c["core"], F.lit("("))).alias("too_deep"),
            c["start_line"].alias("start_line"),
            (span["off"] + F.octet_length(prefix)).alias("start_off"),
            F.when(first_on_line, span["end_line"])
            .otherwise(block_end_line(lines, c["start_line"]))
            .alias("end_line"),
            header["kind"].alias("kind"),
            header["name"].alias("name"),
            header["type_name"].alias("type_name"),
            header["params"].alias("params"),
            F.sort_array(
                F.array_distinct(F.regexp_extract_all(words, F.lit(r"[\w-]+"), F.lit(0)))
            ).alias("modifiers"),
            F.when(noted, _annotations(prefix)).otherwise(F.expr(NO_ANNOTATIONS)).alias("annotations"),
        )

    return F.transform(F.transform(F.transform(candidates, cut), clean), part)


def parse_files(
    files: DataFrame,
    docs: bool = False,
    metrics: bool = False,
    findings: bool = False,
    cyclomatic_limit: int = CYCLOMATIC_LIMIT,
    loc_limit: int = LOC_LIMIT,
) -> DataFrame:
    """files(repo, file_ord, file_path, source) to one row of facts per file, without the text.

    Columns: repo, file_ord, file_path, problem, package, imports, types. Each type holds
    its methods. ``docs``, ``metrics`` and ``findings`` add doc comments, method metrics
    and rule findings; what is not asked for is not computed. The tables below are read
    off this frame; where several are needed, make it ``durable`` first, so that the texts
    are read once.
    """
    lined = computed_once(
        files.withColumnRenamed("source", "_raw"),
        source=F.when(F.contains("_raw", F.lit("\r")), normalize_newlines(F.col("_raw"))).otherwise(F.col("_raw")),
    ).drop("_raw")
    chunked = computed_once(
        lined,
        # the added newline ends a line comment, so no comment's brace is a chunk's last character
        chunks=F.regexp_extract_all(F.concat("source", F.lit("\n")), F.lit(P.CHUNK), F.lit(0)),
        lines=source_lines(F.col("source")),
    )
    folded = computed_once(chunked, fold=_block_spans(F.transform("chunks", _chunk_facts)))
    tail = F.regexp_replace(
        F.array_join(
            F.slice(
                "chunks",
                F.greatest(F.size("chunks") - 1, F.lit(1)),
                F.least(F.size("chunks"), F.lit(2)),
            ),
            "",
        ),
        f"{P.LINE_COMMENT}|{P.CLOSED_BLOCK_COMMENT}",
        "",
    )
    reason = (
        F.when(F.col("fold.underflow"), "closing brace without an opening one")
        .when(F.col("fold.top").isNotNull(), "block not closed")
        .when(~F.regexp_like(tail, F.lit(r"(?s)(?:\A|[{};])\s*\z")), "text after the last declaration")
    )
    headers = F.filter(
        _statements(F.get("chunks", F.lit(0))),
        lambda c: (F.contains(c, F.lit("import")) | F.contains(c, F.lit("package")))
        & F.regexp_like(c, F.lit(P.PACKAGE_OR_IMPORT)),
    )
    header_text = F.transform(headers, _bare)

    def named(keyword: str) -> Column:
        """Names behind a keyword in the file's header statements."""
        name = rf"(?U)^{keyword}\s+(?:static\s+)?([\w$.\s]+?)\s*(?:\.\s*\*)?\s*;$"
        behind = F.filter("header", lambda c: F.startswith(c, F.lit(keyword)))
        return F.filter(F.transform(behind, lambda c: F.regexp_extract(c, name, 1)), lambda n: n != "")

    too_deep = F.when(F.exists("decls", lambda d: d["too_deep"]), "annotation nested too deep")
    described = computed_once(
        folded,
        header=header_text,
        decls=_describe(_candidates(F.col("fold.spans"), F.col("chunks")), F.col("lines")),
    ).withColumn("problem", F.coalesce(reason, too_deep))
    sound = F.col("problem").isNull()
    no_decls = F.slice("decls", 1, 0)
    ordered = computed_once(
        described,
        ordered=_ordered_types(F.when(sound, F.col("decls")).otherwise(no_decls)),
        docs=_doc_comments(F.col("source")) if docs else F.lit(None),
        bytes=F.col("source").cast("binary") if docs else F.lit(None),
    )
    wanted = _Wanted(docs, metrics, findings, cyclomatic_limit, loc_limit)
    return ordered.select(
        "repo",
        "file_ord",
        "file_path",
        "problem",
        F.coalesce(F.get(named("package"), F.lit(0)), F.lit("")).alias("package"),
        named("import").alias("imports"),
        F.transform("ordered", lambda t, i: _type_facts(t, i, wanted)).alias("types"),
    )


@dataclass(frozen=True)
class _Wanted:
    docs: bool
    metrics: bool
    findings: bool
    cyclomatic_limit: int
    loc_limit: int


def _checked_order(file_ord: Column) -> Column:
    """``file_ord``, or an error where keys made of it would collide."""
    message = F.concat(F.lit("file_ord has to be from 0 to below 2^35, see number_sources: "), file_ord.cast("string"))
    fits = (file_ord >= 0) & (file_ord < F.lit(1 << (63 - ORD_BITS)))
    return F.when(file_ord.isNull() | fits, file_ord).otherwise(F.raise_error(message).cast("bigint"))


def _type_facts(t: Column, i: Column, wanted: _Wanted) -> Column:
    fields = [
        (F.shiftleft(_checked_order(F.col("file_ord")), ORD_BITS) + i).alias("type_ord"),
        t["name"].alias("class_name"),
        t["kind"].alias("kind"),
        t["annotations"].alias("annotations"),
        class_role(F.col("file_path"), t["annotations"]).alias("class_type"),
        t["start_line"].alias("start_line"),
        t["end_line"].alias("end_line"),
        _method_facts(t, wanted).alias("methods"),
    ]
    if wanted.docs:
        # The first place that looks like the declaration anchors its doc comment.
        anchor = F.concat(F.lit(P.TYPE_ANCHOR + r"\Q"), t["name"], F.lit(r"\E\b"))
        around = F.split("source", anchor, 2)  # offsets count bytes, not UTF-16 units
        offset = let(around, lambda a: F.when(F.size(a) > 1, F.octet_length(a[0])).otherwise(0)).cast("bigint")
        fields.append(
            let(offset, lambda at: doc_before(F.col("bytes"), F.col("docs"), at)).alias("javadoc")
        )
    if wanted.findings:
        body = line_span(F.col("lines"), t["start_line"], t["end_line"])
        fields.append(
            let(body, lambda text: text_findings(text, t["start_line"])).alias("findings")
        )
    return F.struct(*fields)


def _method_facts(t: Column, wanted: _Wanted) -> Column:
    """Constructors, then methods, of a type in source order."""
    mine = F.filter(
        "decls",
        lambda d: (~d["is_type"])
        & (d["owner"] == t["idx"])
        & (d["name"] != "")
        & ((d["type_name"] != "") | (d["name"] == t["name"])),
    )
    keyed = F.sort_array(
        F.transform(
            mine,
            lambda d: F.struct((d["type_name"] != "").alias("k"), d["start_off"].alias("i"), d.alias("d")),
        )
    )

    def read(d: Column) -> Column:
        """What a method's row refers to more than once."""
        body = line_span(F.col("lines"), d["start_line"], d["end_line"])
        paths = [cyclomatic(body).alias("paths")] if wanted.metrics else []
        return F.struct(d.alias("d"), _parameters(d["params"]).alias("parameters"), *paths)

    def fields(method: Column, j: Column) -> Column:
        d, parameters = method["d"], method["parameters"]
        returned = F.when(d["type_name"] == "", F.lit("void")).otherwise(d["type_name"])
        out = [
            j.cast("bigint").alias("method_ord"),
            d["name"].alias("name"),
            F.concat(
                returned, F.lit(" "), d["name"], F.lit("("), F.array_join(parameters, ", "), F.lit(")")
            ).alias("signature"),
            returned.alias("return_type"),
            parameters.alias("parameters"),
            d["modifiers"].alias("modifiers"),
            d["annotations"].alias("annotations"),
            d["start_line"].alias("start_line"),
            d["end_line"].alias("end_line"),
        ]
        if wanted.docs:
            out.append(doc_before(F.col("bytes"), F.col("docs"), d["start_off"]).alias("javadoc"))
        if wanted.metrics:
            loc = (d["end_line"] - d["start_line"] + 1).alias("loc")
            heavy = high_complexity(method["paths"], loc, wanted.cyclomatic_limit, wanted.loc_limit)
            out += [loc, method["paths"].alias("cyclomatic"), heavy.alias("high_complexity")]
        return F.struct(*out)

    return F.transform(F.transform(keyed, lambda s: read(s["d"])), fields)


def file_errors(parsed: DataFrame) -> DataFrame:
    """One row per file set aside, with its error text; the run goes on without it."""
    return parsed.filter(F.col("problem").isNotNull()).select(
        "repo",
        "file_ord",
        "file_path",
        F.concat_ws(": ", "file_path", "problem").alias("error"),
    )


# Fixed value: order in which the three declaration kinds are listed.
_KIND_RANK = {"class": 0, "interface": 1, "enum": 2}


def _kind_rank(kind: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in _KIND_RANK.items():
        rank = F.when(kind == name, F.lit(value)).otherwise(rank)
    return rank


def _ordered_types(decls: Column) -> Column:
    """Type declarations in listing order: by kind, then by position."""
    types = F.filter(decls, lambda d: d["is_type"])
    keyed = F.transform(
        types, lambda d: F.struct(_kind_rank(d["kind"]).alias("k"), d["start_off"].alias("i"), d.alias("d"))
    )
    return F.transform(F.sort_array(keyed), lambda s: s["d"])


def _typed(parsed: DataFrame, *extra: str) -> DataFrame:
    """One row per type with all its facts."""
    return parsed.select("repo", "file_path", *extra, F.explode("types").alias("t"))


def type_table(parsed: DataFrame) -> DataFrame:
    """One row per class, interface and enum, with the number of its (heavy) methods."""
    rows = _typed(parsed, "package")
    members = rows.schema["t"].dataType["methods"].dataType.elementType.names
    heavy = (
        [F.size(F.filter("t.methods", lambda m: m["high_complexity"])).cast("bigint").alias("heavy_methods")]
        if "high_complexity" in members
        else []
    )
    lists = ("methods", "findings")
    plain = [f"t.{name}" for name in rows.schema["t"].dataType.names if name not in lists]
    return rows.select(
        "repo", "file_path", "package", *plain, F.size("t.methods").cast("bigint").alias("n_methods"), *heavy
    )


def method_table(parsed: DataFrame) -> DataFrame:
    """One row per constructor and method of each type."""
    return _typed(parsed).select(
        "repo",
        "file_path",
        F.col("t.type_ord").alias("type_ord"),
        F.col("t.class_name").alias("class_name"),
        F.inline("t.methods"),
    )


def finding_table(parsed: DataFrame) -> DataFrame:
    """One row per finding of each type, in rule order; needs ``findings``."""
    return (
        _typed(parsed)
        .select(
            "repo",
            "file_path",
            F.col("t.type_ord").alias("type_ord"),
            F.col("t.class_name").alias("class_name"),
            F.posexplode("t.findings").alias("finding_ord", "f"),
        )
        .select("repo", "file_path", "type_ord", "class_name", "finding_ord", "f.*")
    )


def import_table(parsed: DataFrame) -> DataFrame:
    """Imports of each type: every type of a file has all imports of the file."""
    return _typed(parsed, "imports").select(
        "repo",
        F.col("t.type_ord").alias("type_ord"),
        "file_path",
        F.col("t.class_name").alias("class_name"),
        F.explode("imports").alias("import_path"),
    )


# Annotation and path keyword to role, in order of precedence.
ANNOTATION_ROLES = {
    "RestController": "controller",
    "Controller": "controller",
    "Service": "service",
    "Repository": "repository",
    "Entity": "entity",
    "Configuration": "config",
}
PATH_ROLES = (
    "controller", "service", "repository", "entity", "dto", "mapper", "assembler", "config", "exception",
)


def class_role(path: Column, annotations: Column) -> Column:
    """First annotation with a role; else first path keyword in order; else 'other'."""
    roles = F.create_map(*[F.lit(text) for pair in ANNOTATION_ROLES.items() for text in pair])
    hinted = F.filter(annotations, lambda a: a["name"].isin(*ANNOTATION_ROLES))
    by_annotation = F.try_element_at(roles, F.get(hinted, F.lit(0))["name"])

    def by_path(lowered: Column) -> Column:
        role = F.lit("other")
        for keyword in reversed(PATH_ROLES):
            role = F.when(F.contains(lowered, F.lit(f"/{keyword}/")), F.lit(keyword)).otherwise(role)
        return role

    return F.coalesce(by_annotation, let(F.concat(F.lit("/"), F.lower(path)), by_path))


# Mapping annotation to verb.
ROUTE_VERBS = {
    "GetMapping": "GET",
    "PostMapping": "POST",
    "PutMapping": "PUT",
    "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
    "RequestMapping": "REQUEST",
}


def _route_path(arguments: Column) -> Column:
    """Of an annotation's arguments the first that is ``value=``/``path=`` or has no '='; '' without one."""
    usable = F.filter(
        arguments,
        lambda a: F.startswith(a, F.lit("value=")) | F.startswith(a, F.lit("path=")) | ~F.contains(a, F.lit("=")),
    )
    return F.coalesce(F.regexp_replace(F.get(usable, F.lit(0)), r"^(?:value|path)=", ""), F.lit(""))


def route_table(parsed: DataFrame) -> DataFrame:
    """Routes from mapping annotations: class base path + method path.

    A type's row holds its methods, so base and method path meet without a join.
    """
    base = F.rtrim(
        _route_path(
            F.get(
                F.filter("t.annotations", lambda a: a["name"] == "RequestMapping"), F.lit(0)
            )["arguments"]
        ),
        F.lit("/"),
    )
    verbs = F.create_map(*[F.lit(text) for pair in ROUTE_VERBS.items() for text in pair])
    mapped = F.flatten(
        F.transform(
            "t.methods",
            lambda m: F.transform(
                F.filter(m["annotations"], lambda a: a["name"].isin(*ROUTE_VERBS)),
                lambda a: F.struct(
                    F.try_element_at(verbs, a["name"]).alias("http_method"),
                    _route_path(a["arguments"]).alias("tail"),
                ),
            ),
        )
    )
    rows = (
        _typed(parsed)
        .select(
            "repo",
            F.col("t.type_ord").alias("type_ord"),
            "file_path",
            F.col("t.class_name").alias("class_name"),
            base.alias("base"),
            F.posexplode(mapped).alias("endpoint_ord", "route"),
        )
        .withColumn("tail", F.col("route.tail"))
    )
    rooted = F.when(
        (F.col("tail") != "") & ~F.startswith("tail", F.lit("/")), F.concat(F.lit("/"), "tail")
    ).otherwise(F.col("tail"))
    path = F.concat("base", rooted)
    return rows.select(
        "repo",
        "type_ord",
        "file_path",
        "class_name",
        F.col("endpoint_ord").cast("bigint").alias("endpoint_ord"),
        F.col("route.http_method").alias("http_method"),
        F.when(path == "", "/").otherwise(path).alias("path"),
    )


def block_end_line(lines: Column, start_line: Column) -> Column:
    """Line where the block opened at ``start_line`` closes, counted from that line's start.

    A ';' before any '{' ends it at once; an unbalanced rest ends at the last line.
    """
    rest = line_span(lines, start_line, F.size(lines).cast("bigint"))
    tokens = F.regexp_extract_all(rest, F.lit(f"{P.MASK}|[{{}};\\n]"), F.lit(0))
    start = F.struct(
        start_line.cast("bigint").alias("line"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("started"),
        F.lit(None).cast("bigint").alias("found"),
    )

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        started = state["started"] | (token == "{")
        ends = ((token == "}") & state["started"] & (depth == 0)) | ((token == ";") & ~state["started"])
        return F.struct(
            (state["line"] + newline_count(token)).alias("line"),
            depth.alias("depth"),
            started.alias("started"),
            F.coalesce(state["found"], F.when(ends, state["line"])).alias("found"),
        )

    return F.aggregate(
        tokens, start, step, lambda s: F.coalesce(s["found"], F.size(lines).cast("bigint"))
    )


__all__ = [
    "annotation_arguments",
    "block_end_line",
    "class_role",
    "doc_before",
    "file_errors",
    "finding_table",
    "import_table",
    "method_table",
    "parse_files",
    "route_table",
    "type_table",
]
