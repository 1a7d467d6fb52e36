"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text is normalised (every run of ``[\\x20\\x09-\\x0D]`` becomes one space; null is empty) and
cut into chunks of ``CHUNK_BYTES`` bytes. Each chunk gets two polynomial hashes
``sum((b_i + 1) * B^i) mod P`` over its bytes, independently of the others; the hash of the
whole text is the sum of the chunk hashes shifted by ``B^(chunk start)``, so chunks of any
document can be hashed in any task and combined by a plain sum. Rows whose key (both hashes and
the byte length) is equal form a candidate group; every member's chunks are then compared with
the chunks of the group's first row, chunk by chunk, before the rows are taken as equal.

Definitions (what the operator returns for odd input):

* null text counts as empty; empty texts are equal to each other;
* of equal texts, the row with the smallest ``doc_id`` stays; rows with a null ``doc_id`` come
  after all others, and a group of such rows only keeps one of them with ``keep_id`` null;
* repeated rows (same ``doc_id``, same text) are all returned; exactly one of them is kept if
  their id is the group's smallest;
* other columns of ``docs`` are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import chunks, stored

SPACE_RUN = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 13
#: bytes hashed at once in a task: its 64-bit temporaries take eight times as much
SLICE_BYTES = 1 << 20
#: two Mersenne-sized primes and bases: 62 bits of fingerprint beside the byte length
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 911382323)
KEY = ["__fp1", "__fp2", "__bytes"]
#: an entry is a distinct (id, text); ids as two columns that are never null, so joins need no null-safe keys
ENTRY = ["__nul", "__idk", "__sha"]
REP = ["__rep_nul", "__rep_idk", "__rep_sha"]


def normalised(text: Column) -> Column:
    """UTF-8 bytes of the text with each run of white space as one space; null is empty."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), "UTF-8")


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    value = 1
    step = base % prime
    # a doubling table would do too; n is one chunk, computed once per task
    for i in range(n):
        out[i] = value
        value = value * step % prime
    return out


_TABLES: dict[int, np.ndarray] = {}


def _table(k: int) -> np.ndarray:
    if k not in _TABLES:
        _TABLES[k] = _powers(BASES[k], PRIMES[k], CHUNK_BYTES)
    return _TABLES[k]


def chunk_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Hash ``k`` of each chunk: ``sum((b_i + 1) * B^i) mod P``, i from 0 in the chunk."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    out = np.zeros(n, dtype=np.int64)
    if not len(data):
        return out
    starts = np.repeat(offsets[:-1], lengths)
    position = np.arange(len(data), dtype=np.int64) - starts
    terms = (data.astype(np.int64) + 1) * _table(k)[position] % PRIMES[k]
    full = lengths > 0
    out[full] = np.add.reduceat(terms, offsets[:-1][full]) % PRIMES[k]
    return out


def shift(hashes: np.ndarray, chunk_index: np.ndarray, k: int) -> np.ndarray:
    """Each hash times ``B^(chunk_index * CHUNK_BYTES)`` mod P: its place in the whole text."""
    prime, step = PRIMES[k], pow(BASES[k], CHUNK_BYTES, PRIMES[k])
    factors = np.array([pow(step, int(j), prime) for j in chunk_index], dtype=np.int64)
    return hashes % prime * factors % prime


def fingerprint(text: bytes, k: int) -> int:
    """Plain-Python hash ``k`` of a whole normalised text, for tests."""
    prime, base = PRIMES[k], BASES[k]
    return sum((b + 1) * pow(base, i, prime) for i, b in enumerate(text)) % prime


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk = batch.column("__chunk")
        if isinstance(chunk, pa.ChunkedArray):
            chunk = chunk.combine_chunks()
        chunk = chunk.cast(pa.large_binary())
        _, ends, data = chunk.buffers()
        offsets = np.frombuffer(ends, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
        index = batch.column("__j").to_numpy(zero_copy_only=False)
        out = [np.zeros(len(chunk), dtype=np.int64) for _ in range(2)]
        for low, high in chunks(offsets, SLICE_BYTES):
            part = raw[offsets[low] : offsets[high]]
            for k in range(2):
                out[k][low:high] = shift(chunk_hashes(part, offsets[low : high + 1] - offsets[low], k), index[low:high], k)
        names = [n for n in batch.schema.names if n != "__chunk"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, out)], names=[*names, "__t1", "__t2"])


def _chunks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per chunk of each text: its index ``__j`` and bytes ``__chunk``."""
    count = F.greatest(F.lit(1), F.ceil(F.col("__bytes") / CHUNK_BYTES)).cast("int")
    index = rows.select(*keep, "__text", F.explode(F.sequence(F.lit(0), count - 1)).alias("__j"))
    return index.select(*keep, "__j", F.substring("__text", F.col("__j") * CHUNK_BYTES + 1, CHUNK_BYTES).alias("__chunk"))


def entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts as (id, digest, bytes) with their fingerprint and number of repeated rows.

    Also returns the normalised rows, for reading chunks again.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), normalised(F.col(text)).alias("__text"))
    rows = rows.select(F.col("__id").isNull().alias("__nul"), F.coalesce("__id", F.lit(-1)).alias("__idk"), "__text", F.sha2("__text", 256).alias("__sha"), F.octet_length("__text").cast("long").alias("__bytes"))
    keep = [*ENTRY, "__bytes"]
    terms = _chunks(rows, keep)
    schema = terms.drop("__chunk").schema.add("__t1", "long").add("__t2", "long")
    hashed = terms.mapInArrow(_terms, schema)
    # repeated rows bring every chunk once per copy: the sums are multiples of the copies
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("__bytes") / CHUNK_BYTES))
    found = hashed.groupBy(*keep).agg(F.sum("__t1").alias("s1"), F.sum("__t2").alias("s2"), F.count(F.lit(1)).alias("seen"))
    copies = (F.col("seen") / n_chunks).cast("long")
    found = found.select(
        *keep,
        copies.alias("__copies"),
        F.pmod(F.col("s1").cast("decimal(38,0)") / copies, F.lit(PRIMES[0])).cast("long").alias("__fp1"),
        F.pmod(F.col("s2").cast("decimal(38,0)") / copies, F.lit(PRIMES[1])).cast("long").alias("__fp2"),
    )
    return found, rows


def _first(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: its first entry (smallest id, nulls last, then digest), entries and rows."""
    first = F.min(F.struct(*ENTRY))
    out = rows.groupBy(*by).agg(first.alias("f"), F.count(F.lit(1)).alias("__entries"))
    return out.select(*by, *(F.col(f"f.{e}").alias(r) for e, r in zip(ENTRY, REP)), "__entries")


def _is_rep() -> Column:
    return (F.col("__nul") == F.col("__rep_nul")) & (F.col("__idk") == F.col("__rep_idk")) & (F.col("__sha") == F.col("__rep_sha"))


def _mismatched(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of ``candidates`` whose chunks are not all equal to their representative's."""
    wanted = candidates.select(*ENTRY, *KEY, *REP, "__round")
    texts = rows.join(wanted, [*ENTRY, "__bytes"]).select(*ENTRY, *KEY, *REP, "__round", "__text")
    chunks = stored(_chunks(texts, [*ENTRY, *KEY, *REP, "__round"]), "exact-chunks")
    own = chunks.where(_is_rep())
    # a representative repeated in many rows brings its chunks once
    own = own.select(*KEY, "__round", "__j", F.col("__chunk").alias("__rep_chunk")).dropDuplicates([*KEY, "__round", "__j"])
    compared = chunks.join(own, [*KEY, "__round", "__j"], "left")
    same = compared.groupBy(*ENTRY, *KEY, "__round").agg(F.min(F.coalesce(F.col("__chunk") == F.col("__rep_chunk"), F.lit(False))).alias("__same"))
    return same.where(~F.col("__same")).select(*ENTRY, *KEY, "__round")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct (id, text) of ``docs``: its representative, group size and copies.

    Columns: the entry (``__nul, __idk, __sha``), ``__copies``, its representative (``__rep_nul, __rep_idk, __rep_sha``), ``__size``.
    """
    found, rows = entries(docs, doc_id, text)
    found = stored(found.withColumn("__round", F.lit(0)), "exact-entries")
    settled = []
    open_ = found
    for round_ in range(64):  # each round settles at least the representative of every key
        firsts = _first(open_, [*KEY, "__round"])
        assigned = open_.join(firsts, [*KEY, "__round"])
        single = assigned.where(F.col("__entries") == 1)
        many = stored(assigned.where(F.col("__entries") > 1), "exact-candidates")
        wrong = stored(_mismatched(many, rows), "exact-mismatched")
        if wrong.isEmpty():
            settled += [single, many]
            break
        keys = [*ENTRY, *KEY, "__round"]
        right = many.join(wrong.withColumn("__wrong", F.lit(True)), keys, "left").where(F.col("__wrong").isNull()).drop("__wrong")
        settled += [single, right]
        open_ = stored(many.join(wrong, keys, "left_semi").drop(*REP, "__entries").withColumn("__round", F.lit(round_ + 1)), "exact-open")
    else:  # pragma: no cover - a second collision in 62 bits, 64 times over
        raise RuntimeError("fingerprint collisions did not settle")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.select(*ENTRY, "__copies", *KEY, "__round", *REP)
    sizes = out.groupBy(*KEY, "__round", *REP).agg(F.sum("__copies").alias("__size"))
    return out.join(sizes, [*KEY, "__round", *REP], "left").drop(*KEY, "__round")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = groups(docs, doc_id, text)
    rows = found.select("*", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    return rows.select(
        F.when(~F.col("__nul"), F.col("__idk")).alias("doc_id"),
        F.when(~F.col("__rep_nul"), F.col("__rep_idk")).alias("keep_id"),
        F.col("__size").cast("long").alias("group_size"),
        (_is_rep() & (F.col("__copy") == 1)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
