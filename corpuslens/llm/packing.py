"""Best-fit packing of documents into sequences of bounded length, under conflicts.

A document longer than a sequence fills whole sequences by itself; what remains of it is one
item. Items are dealt to groups of bounded size by a hash of the row, so neither a frequent
source nor a large cluster of copies makes a group large, and each group is packed by itself:

* items are taken by falling length;
* open bins stand in the order of their room, each with a bitmap of the sources and one of the
  duplicate clusters it holds (bit i: the group's i-th source or cluster, so bits are exact);
* an item looks up the bin with the least sufficient room and goes on to its successors until
  a bin has neither its source nor its cluster; that is the tightest compatible bin. If there
  is none, a bin is opened.

Result for odd input: a document without words has one row without bin; a null source or
cluster never conflicts; repeated rows are items of their own, which conflict with each other
by their cluster; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SPACE_WORD_PATTERN, stored

#: Items that are packed together.
GROUP_ITEMS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD_PATTERN)).cast("bigint")


def best_fit(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and place in it of each item; items come by falling size. None conflicts with nothing."""
    bits: dict = {}

    def bit(kind: str, value) -> int:  # noqa: ANN001
        return 0 if value is None else 1 << bits.setdefault(kind, {}).setdefault(value, len(bits[kind]))

    room: list[tuple[int, int]] = []  # (what is left, bin), sorted
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    filled: list[int] = []
    bins, places = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = bit("source", source), bit("cluster", cluster)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (held[room[at][1]][0] & s or held[room[at][1]][1] & c):
            at += 1
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            left, chosen = capacity, len(held)
            held.append((0, 0))
            filled.append(0)
        held[chosen] = held[chosen][0] | s, held[chosen][1] | c
        bins.append(chosen)
        places.append(filled[chosen])
        filled[chosen] += 1
        if left > size:
            insort(room, (left - size, chosen))
    return bins, places


def packed(
    docs: DataFrame,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: Column | None = None,
) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin, place): where the words of each document go.

    ``cluster``: the duplicate cluster of a row, else the digest of its text. ``bin`` names a
    sequence; its pieces follow each other by ``place``.
    """
    cluster = F.md5(F.col(text).cast("binary")) if cluster is None else cluster
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.cast("string").alias("cluster"), word_count(F.col(text)).alias("words")
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    whole = (F.col("words") / capacity).cast("bigint")
    full = rows.where(F.col("words") >= capacity).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
    full = full.select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("first_word"), F.lit(capacity).cast("bigint").alias("n_words"),
        F.concat_ws("-", F.lit("whole"), "row", "piece").alias("bin"), F.lit(0).cast("bigint").alias("place"),
    )
    blank = rows.where(F.col("words") == 0).select(
        "doc_id", *(F.lit(0).cast("bigint").alias(n) for n in ("piece", "first_word", "n_words")), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("bigint").alias("place")
    )
    items = rows.where(F.col("words") % capacity > 0)
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    items = items.select(
        "doc_id", "row", "source", "cluster", (F.col("words") % capacity).alias("n_words"), whole.alias("piece"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "row"], ascending=[False, True])
        none = lambda names: [None if pd.isna(x) else x for x in names]
        bins, places = best_fit(group.n_words.tolist(), none(group.source), none(group.cluster), capacity)
        number = group.group.iloc[0]
        out = group[["doc_id", "piece"]].assign(first_word=group.piece * capacity, n_words=group.n_words)
        return out.assign(bin=[f"shared-{number}-{b}" for b in bins], place=places)

    kind = dict(docs.dtypes)[doc_id]
    shared = items.groupBy("group").applyInPandas(pack, f"doc_id {kind}, piece bigint, first_word bigint, n_words bigint, bin string, place bigint")
    return full.unionByName(shared).unionByName(blank)
