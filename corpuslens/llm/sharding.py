"""Weighted rendezvous hashing of record keys over shards, with built-in functions only.

Every shard draws a pseudo-random number from the key and its own number; the shard with the
largest weighted draw takes the record. A new shard wins only records whose draw it tops, so
records move to it and nowhere else, and about ``1 / n`` of them do.

Result for odd input: a null text has 16 bytes and checksum 0; a record without key is dealt
by the hash of its text; repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import stored

#: Rows of a shard that are numbered together.
SLOT_ROWS = 50_000


def draw(key: Column, shard: int, weight: float) -> Column:
    """The draw of one shard: ``-weight / ln(u)`` with ``u`` uniform in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-weight) / F.ln(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``; equal draws go to the smaller number."""
    draws = [F.struct(draw(key, i, w).alias("draw"), F.lit(-i).alias("rank")) for i, w in enumerate(weights)]
    return (-F.greatest(*draws)["rank"]).cast("int") if len(draws) > 1 else F.lit(0)


def record_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("id:"), doc_id.cast("string")), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def sharded(docs: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard): ``grown_shard`` is with one more shard.

    The further shard weighs as much as the mean of the others.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = record_key(F.col(doc_id), F.col(text))
    more = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), key.alias("key"), (F.octet_length(body) + F.lit(16)).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    return rows.select("doc_id", "size", "text_crc32", rendezvous(F.col("key"), weights).alias("shard"), rendezvous(F.col("key"), more).alias("grown_shard"))


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``: a gapless number from 0 within the shard.

    Equal rows are counted first. The others of a shard fall into hash parts of about
    ``SLOT_ROWS``, whose lengths are summed; only then are rows numbered, part by part.
    """
    names = rows.columns
    counted = stored(rows.groupBy(*names).agg(F.count("*").alias("__copies")), "sharded")
    parts = max(1, counted.count() // SLOT_ROWS)
    counted = counted.withColumn("__part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    per_part = counted.groupBy(shard, "__part").agg(F.sum("__copies").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(shard).orderBy("__part")) - F.col("__n")
    offsets = per_part.select(F.col(shard).alias("__shard"), F.col("__part").alias("__of"), before.alias("__before"))
    inside = F.sum("__copies").over(W.partitionBy(shard, "__part").orderBy(*names)) - F.col("__copies")
    placed = counted.withColumn("__inside", inside).join(offsets, (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__of")))
    first = F.col("__before") + F.col("__inside")
    return placed.select(*names, F.explode(F.sequence(first, first + F.col("__copies") - 1)).alias("slot"))
