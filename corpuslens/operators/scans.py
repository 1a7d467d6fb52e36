"""Rule scans over text: one pass, findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import patterns as P
from corpuslens.functions.durable import let
from corpuslens.functions.text import matches_with_line

# Category, severity and message of each rule.
SECRET = ("hardcoded_secret", "high", "Hardcoded credential-like value in field '{}'.")
SQL = (
    "sql_injection_risk",
    "medium",
    "SQL string appears to be built via concatenation rather than a parameterized query.",
)
CATCH = ("empty_catch_block", "low", "Empty catch block silently swallows the exception.")
SEVERITIES = ("high", "medium", "low")


def _finding(rule: tuple[str, str, str], message: Column, line: Column) -> Column:
    return F.struct(
        F.lit(rule[0]).alias("category"),
        F.lit(rule[1]).alias("severity"),
        message.alias("message"),
        line.cast("bigint").alias("line"),
    )


def secret_findings(text: Column, first_line: Column, type_prefix: str = r"String\s+") -> Column:
    pattern = P.secret_assignment(type_prefix)
    hits = F.filter(
        matches_with_line(text, pattern, first_line),
        lambda m: ~F.regexp_like(F.regexp_extract(m["text"], pattern, 2), F.lit(P.SECRET_PLACEHOLDER)),
    )
    before, after = SECRET[2].split("{}")
    return F.transform(
        hits,
        lambda m: _finding(
            SECRET,
            F.concat(F.lit(before), F.regexp_extract(m["text"], pattern, 1), F.lit(after)),
            m["line"],
        ),
    )


def sql_findings(text: Column, first_line: Column) -> Column:
    """One finding per line with a quoted SQL keyword and a '+'."""
    no_lines = F.when(text.isNotNull(), F.array().cast("array<string>"))
    may = F.contains(text, F.lit("+")) & F.contains(text, F.lit('"'))
    lines = F.when(may, F.split(text, "\n", -1)).otherwise(no_lines)
    numbered = F.transform(
        lines,
        lambda line, i: F.when(
            F.contains(line, F.lit("+"))
            & F.contains(line, F.lit('"'))
            & F.regexp_like(line, F.lit(P.SQL_LITERAL)),
            first_line + i,
        ),
    )
    return F.transform(
        F.filter(numbered, lambda n: n.isNotNull()), lambda n: _finding(SQL, F.lit(SQL[2]), n)
    )


def catch_findings(text: Column, first_line: Column) -> Column:
    """Catch blocks whose body is blank once comments are gone."""

    def is_blank(match: Column) -> Column:
        body = F.regexp_extract(match["text"], P.CATCH_BLOCK, 1)
        body = F.regexp_replace(body, P.CLOSED_BLOCK_COMMENT, "")
        body = F.regexp_replace(body, P.LINE_COMMENT, "")
        return F.regexp_like(body, F.lit(r"(?U)^\s*+\z"))

    hits = F.filter(matches_with_line(text, P.CATCH_BLOCK, first_line), is_blank)
    return F.transform(hits, lambda m: _finding(CATCH, F.lit(CATCH[2]), m["line"]))


ALL_RULES = ("secrets", "sql", "catch")


def text_findings(
    text: Column,
    first_line: Column,
    rules: tuple[str, ...] = ALL_RULES,
    type_prefix: str = r"String\s+",
) -> Column:
    """Findings of a text as one list, in rule order."""
    found = {
        "secrets": lambda: secret_findings(text, first_line, type_prefix),
        "sql": lambda: sql_findings(text, first_line),
        "catch": lambda: catch_findings(text, first_line),
    }
    return F.concat(*[found[name]() for name in rules])


def scan(
    texts: DataFrame,
    rules: tuple[str, ...] = ALL_RULES,
    text: str = "body",
    first_line: str = "start_line",
    type_prefix: str = r"String\s+",
) -> DataFrame:
    """Findings of each text in rule order; all other columns are kept, the text is dropped.

    The rules' results are concatenated in the row, so one scan of the text serves all.
    """
    keep = [c for c in texts.columns if c not in (text, first_line)]
    found = let(F.col(text), lambda t: text_findings(t, F.col(first_line), rules, type_prefix))
    return texts.select(*keep, F.posexplode(found).alias("finding_ord", "_f")).select(
        *keep, "finding_ord", "_f.*"
    )


def findings_total(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "severity").agg(F.count("*").alias("findings"))
