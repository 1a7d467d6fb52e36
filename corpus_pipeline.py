"""A corpus through five stages: toxicity, SimHash near-duplicates, decontamination, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, packing, pii, simhash, toxicity
from corpuslens.llm.common import free_name, row_key, stored
from corpuslens.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the lexicon is learned from ``labels``."""
    return toxicity.without_toxic(docs, toxicity_model(docs, spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the group's row with the smallest id.

    Groups are the components of op4's operator: fingerprints of 4-word shingles that differ in
    at most 4 bits are linked. Of rows repeating that row in id and text, one stays.
    """
    found = simhash.near_duplicates(docs, words=4, distance=4)
    leads = found.where(F.col("row_key") == F.col("first_key")).select(F.col("row_key").alias("lead")).distinct()
    key = free_name(docs, "__row_key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    kept = keyed.join(leads, keyed[key] == leads["lead"], "left_semi")
    return kept.dropDuplicates([key]).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in windows of ``benchmark``."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymised(docs, found_as=free_name(docs, "pii")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of each document go: pieces in bins of 1024 words."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Fingerprints, pseudonyms and best-fit packing are beyond SQL; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
