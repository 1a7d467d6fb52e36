"""Size and branching metrics of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import patterns as P

# Default limits.
CYCLOMATIC_LIMIT = 10
LOC_LIMIT = 40


def cyclomatic(text: Column) -> Column:
    """1 + branching keywords and operators outside comments and literals."""
    found = F.regexp_extract_all(text, F.lit(P.BRANCH_OR_MASK), F.lit(1))
    return (F.lit(1) + F.array_size(F.array_remove(found, ""))).cast("bigint")


def high_complexity(
    paths: Column, loc: Column, cyclomatic_limit: int = CYCLOMATIC_LIMIT, loc_limit: int = LOC_LIMIT
) -> Column:
    return (paths > cyclomatic_limit) | (loc > loc_limit)


def method_metrics(
    methods: DataFrame, cyclomatic_limit: int = CYCLOMATIC_LIMIT, loc_limit: int = LOC_LIMIT
) -> DataFrame:
    """Methods with start_line, end_line and ``body`` to methods with metrics; drops the text."""
    return (
        methods.withColumn("loc", F.col("end_line") - F.col("start_line") + 1)
        .withColumn("cyclomatic", cyclomatic(F.col("body")))
        .drop("body")
        .withColumn(
            "high_complexity",
            high_complexity(F.col("cyclomatic"), F.col("loc"), cyclomatic_limit, loc_limit),
        )
    )
