"""Evaluating an expression once, per row inside a plan or once per run, and joining what was made so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps refer to more than once.

    Catalyst merges neighbouring projections and pushes filters below them by copying
    the expressions, also into lambdas, where they would run per array element. A
    one-element generator is a boundary for both, so costly text expressions run once
    per row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def durable(df: DataFrame) -> DataFrame:
    """``df``, evaluated once for all its readers.

    Written to the checkpoint folder of the session (``spark.checkpoint.dir``, shared
    storage on a cluster), which outlives lost executors. Where that is unset the rows are
    persisted: lost ones are computed again from their lineage.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist()
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: sorted and merged, never broadcast.

    Spark's estimate of a table made of exploded lists and derived texts is that of the
    columns it was read from, also behind a checkpoint. A broadcast chosen by it takes many
    times the estimate through the driver.
    """
    return df.hint("merge")
