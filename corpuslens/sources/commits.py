"""Commit logs as a table of (repo, commit_ord, date, file_path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import trim_space

# Fixed value: the marker opening each commit in the log text.
COMMIT_MARKER = "\x02COMMIT\x02"

EMPTY_COMMITS = "repo string, commit_ord struct<block:bigint,row:bigint>, date string, file_path string"


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of log files named ``<repo>.log``; see :func:`commit_touches`.

    Text before a file's first marker is no record. A file splits at the marker, so a long log is read by many tasks. ``commit_ord``
    is (split start, row in task), which grows along the file.
    """
    raw = spark.read.option("lineSep", COMMIT_MARKER).text(path)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.log)?$", 1).alias("repo"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("commit_ord"),
        F.col("value").alias("record"),
    ).filter(F.regexp_like("record", F.lit(r"\A\d{4,}-\d\d-\d\d\b")))


def commit_touches(records: DataFrame) -> DataFrame:
    """One row per touched path: the record's first line is its date, the rest are paths."""
    lines = F.split("record", r"\r\n|\r|\n")
    return (
        records.select(
            "repo",
            "commit_ord",
            lines[0].alias("date"),
            F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("_line"),
        )
        .select("repo", "commit_ord", "date", trim_space(F.col("_line")).alias("file_path"))
        .filter(F.col("file_path") != "")
    )


def reanchor(commits: DataFrame, prefix: str) -> DataFrame:
    """Keep paths below ``prefix/`` and make them relative to it; '' keeps all."""
    if not prefix:
        return commits
    head = prefix.rstrip("/") + "/"
    return commits.filter(F.col("file_path").startswith(head)).withColumn(
        "file_path", F.col("file_path").substr(len(head) + 1, 2**31 - 1)
    )


def no_commits(spark: SparkSession) -> DataFrame:
    """History that is not available: the same columns, no rows."""
    return spark.createDataFrame([], EMPTY_COMMITS)
