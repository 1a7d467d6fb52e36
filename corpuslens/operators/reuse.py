"""Reuse of earlier results by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_VERSION = "v1"  # fixed value; another version invalidates every stored result


def content_key(text: Column, version: str = PROMPT_VERSION) -> Column:
    return F.sha2(F.concat(F.lit(version + ":"), text), 256)


def split_by_store(keyed: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored columns, misses). One stored row per key.

    Copies of a text share a key; both joins keep the looked-up rows on the side that
    adaptive execution can split.
    """
    hits = keyed.join(store.withColumnRenamed("class_name", "stored_name"), "cache_key")
    misses = keyed.join(store.select("cache_key"), "cache_key", "left_anti")
    return hits, misses


def store_stats(keyed: DataFrame, store: DataFrame) -> DataFrame:
    """Hits and misses per repo, one per lookup."""
    known = store.select("cache_key", F.lit(True).alias("_known"))
    return (
        keyed.join(known, "cache_key", "left")
        .groupBy("repo")
        .agg(F.count_if(F.col("_known")).alias("hits"), F.count_if(F.col("_known").isNull()).alias("misses"))
    )


def admissible(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose result came back as exactly one fragment; only these are stored."""
    return (
        fragments.groupBy(*keys).agg(F.count("*").alias("fragments")).filter(F.col("fragments") == 1).drop("fragments")
    )
