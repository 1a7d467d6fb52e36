"""What several operators share: durable tables, words of Arrow text columns, 64-bit hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of bytes outside white space, or of letters, digits and all beyond ASCII.
#: Both classes are closed over UTF-8, so bytes can be tested instead of characters.
SPACE_WORDS, TEXT_WORDS = "space", "text"
TEXT_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


# --- tables in the shared folder -------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpuslens-")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Evaluated once for all readers, pruned by column for each of them, and still there
    when the executors that made it are lost.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_partitions(df: DataFrame) -> int:
    """Number of tasks that read ``df``: follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


# --- columns ---------------------------------------------------------------------------


def ascii_lower(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by id and content; equal only for repeated rows."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text.cast("binary")), F.lit("-")))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def remainder_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# --- words of Arrow batches ------------------------------------------------------------


@cache
def _is_word(kind: str) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    if kind == SPACE_WORDS:
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
    return table


@cache
def _lower_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose outputs look random (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    undo = lambda x, k: x ^ (x >> np.uint64(k)) ^ (x >> np.uint64(2 * k))  # noqa: E731  3 * k > 63
    inverse = lambda n: np.uint64(pow(n, -1, 1 << 64))
    with np.errstate(over="ignore"):
        x = undo(x, 31) * inverse(0x94D049BB133111EB)
        x = undo(x, 27) * inverse(0xBF58476D1CE4E5B9)
    return undo(x, 30)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, dtype=np.uint64)], dtype=np.uint64)
                inverse = np.uint64(pow(_BASE, -1, 1 << 64))
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, dtype=np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """The words of consecutive rows: byte bounds, 64-bit hashes and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, hashes: bool = True) -> None:
        #: lower-cased bytes of the rows, and where each row begins and ends in them
        self.data, self.offsets = _lower_bytes()[data], offsets
        word = _is_word(kind)[self.data]
        first = np.zeros(len(word) + 1, dtype=bool)
        first[offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        at, n = 0, len(self.starts)
        with np.errstate(over="ignore"):
            while at < n:  # pieces end between words, so that long rows need no long arrays
                low = self.starts[at]
                to = max(at + 1, int(np.searchsorted(self.ends, low + CHUNK_BYTES)))
                high = self.ends[to - 1]
                up, down = _POWERS.first(int(high - low) + 1)
                total = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
                s, e = self.starts[at:to] - low, self.ends[at:to] - low
                out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
                at = to
        return mixed(out)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where ``n`` words of one row begin, and a hash of those words."""
        count = max(0, len(self.starts) - n + 1)
        at = np.flatnonzero(self.rows[:count] == self.rows[n - 1 : n - 1 + count]) if count else np.zeros(0, dtype=np.int64)
        total = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                total = total * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + k]
        return at, mixed(total + np.uint64(n))

    def text(self, first: int, last: int) -> str:
        """Words ``first`` to ``last - 1``, joined by spaces."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last])).decode()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(to, n)
        row = min(to, n)


def words_of(column: pa.Array, kind: str, hashes: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a text column with their words."""
    data, offsets = utf8(column)
    for low, high in chunks(offsets):
        base = offsets[low]
        yield low, high, Words(data[base : offsets[high]], offsets[low : high + 1] - base, kind, hashes)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8; nulls are empty."""
    data, offsets = utf8(column)
    raw = memoryview(data)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(raw[low:high])


def batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``."""
    if values.dtype == bool:
        values = values.astype(np.int64)
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def with_columns_of(batch_in: pa.RecordBatch, names: Sequence[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch and computed ones."""
    return pa.RecordBatch.from_arrays([*(batch_in.column(n) for n in names), *more.values()], names=[*names, *more])
