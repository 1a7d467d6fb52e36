"""Connected components of a large link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, label) with each label followed to the end: pointers double until none moves."""
    while True:
        ahead = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stored(hooks.join(ahead, "label").select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "jumped")
        hooks = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the smallest node it is connected with.

    Each round, every node is hooked to its smallest neighbour if that is smaller, and the
    trees so made become the nodes of the next round, with the links that run between them.
    A node without a smaller neighbour gets one in the next round if its neighbours have other
    ones, so two rounds leave at most half of the nodes. Tables are written between
    rounds, nothing but whether one is empty comes to the driver, and no node's links are ever
    gathered.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    rest = stored(links.where(F.col("a") != F.col("b")).select(*ordered("a", "b")).distinct(), "links")
    labels = None
    while True:
        ends = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).union(rest.select("a", "a").distinct())
        hooks = _roots(stored(ends.groupBy("node").agg(F.min("label").alias("label")), "hooks"))
        if labels is None:
            labels = hooks
        else:
            over = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = stored(labels.join(over, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        of = lambda end: hooks.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: E731, B023
        across = rest.join(of("a"), "a").join(of("b"), "b").where(F.col("a_label") != F.col("b_label"))
        rest = stored(across.select(*ordered("a_label", "b_label")).distinct(), "links")
        if rest.isEmpty():
            return labels
