"""Store of earlier enrichment results, and the document sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "cache_key string, class_name string, description string, "
    "methods array<struct<signature:string,description:string>>, notable_aspects array<string>"
)


def read_results(spark: SparkSession, path: str, refresh: bool = False) -> DataFrame:
    """Stored results; empty where there are none, or where a fresh start is asked for.

    The store is an optimisation: a missing or unreadable one means a cold start.
    Unreadable part files are skipped as well.
    """
    empty = spark.createDataFrame([], RESULT_SCHEMA)
    if refresh:
        return empty
    try:
        stored = spark.read.option("ignoreCorruptFiles", "true").schema(RESULT_SCHEMA).parquet(path)
    except AnalysisException:
        return empty
    return stored


def upsert_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of the same key; all other old ones stay."""
    return old.join(new, "cache_key", "left_anti").unionByName(new)


def write_results(store: DataFrame, path: str) -> None:
    """Write a whole store to a new version folder (never over the one being read)."""
    store.write.mode("errorifexists").parquet(path)


def write_document(parts: DataFrame, path: str) -> None:
    """Document parts as JSON lines, one folder per repo and section, schema beside it."""
    parts.write.mode("errorifexists").partitionBy("repo", "section").json(path)
    spark = parts.sparkSession
    schema = spark.range(1).select(F.lit(parts.schema.json()).alias("value"))
    schema.write.mode("errorifexists").text(path.rstrip("/") + ".schema")
