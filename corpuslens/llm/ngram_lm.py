"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays of
hashes in the shared folder, memory-mapped by the workers that score texts.

Counting goes in three rounds; each task first adds up what it has met and sends it on as
sorted, packed runs, one for each shard, which the shard's task merges.

1. *Words.* Shards are ranges of the word's 64-bit hash, so that all shards in order are one
   sorted array; the place of a word in it is its number.
2. *Pairs.* A pair of word numbers is one 64-bit key; shards are ranges of the key's mixed
   value (a bijection), which spreads the pairs of a frequent word over all shards. Merged
   counts give the counts of counts, from which the discounts follow.
3. *Contexts.* Of each word: how many different words follow it once, twice or more often, and
   how many different words precede it. Shards are ranges of word numbers.

A text's words and one end are tokens; the first follows a start, which is no token. A token
has the probability

    p(w | u) = max(c(u w) - D(c(u w)), 0) / c(u) + g(u) * p(w)
    p(w)     = max(a(w) - d(a(w)), 0) / A + h / (V + 1)

with D and d the modified Kneser-Ney discounts (for counts of 1, 2 and more) of pairs and of
preceding words, a(w) the number of different words before w, A their sum, g(u) and h what the
discounts set free, and V + 1 words: the V known ones and one for all others. Probabilities of
all words after any context add up to 1. A context that was never met leaves p(w).

Shards are as many as tasks that read the input; a worker maps them and looks up sorted keys,
so that pages are touched in order. A scheme other than ``file:`` is read through Arrow's file
systems into unlinked local files, which are mapped instead.

Result for odd input: a null or empty text has one token, its end; without training texts all
scores are those of one unknown word; repeated rows are counted and scored as often as they
stand; a document without id teaches by the remainder of the empty text; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SPACE_WORDS, fresh_path, input_partitions, mixed, unmixed, words_of

#: Entries that a task gathers before it sends them on.
GATHER = 2_000_000
#: Hash of the end token: no word's bytes are hashed to it but by chance.
END = np.uint64(0x5851F42D4C957F2D)
RUN_SCHEMA = "shard int, run binary"


# --- files in the shared folder --------------------------------------------------------


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """Written under another name and renamed, so that a repeated task leaves a whole file."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(values.tobytes())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    values.tofile(own)
    os.replace(own, path)


def map_array(uri: str, dtype: str) -> np.ndarray:
    """The array of a file, mapped into memory."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as own, system.open_input_stream(path) as source:
        while block := source.read(8 << 20):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype=dtype, mode="r") if own.tell() else np.zeros(0, dtype=dtype)


class Shards(NamedTuple):
    """Arrays of one kind, cut into shards; shard ``s`` begins at entry ``offsets[s]``."""

    folder: str
    offsets: np.ndarray

    def open(self, name: str, dtype: str) -> list[np.ndarray]:
        return [map_array(f"{self.folder}/{name}-{s}", dtype) for s in range(len(self.offsets) - 1)]

    @property
    def total(self) -> int:
        return int(self.offsets[-1])


# --- sorted runs of keys with counts ---------------------------------------------------


def _pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all, and counts; compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) for x in (steps, *(c.astype("<u4") for c in counts))]
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + b"".join(p.tobytes() for p in planes))


def _unpack(run: bytes, counts: int) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(run)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for width in (8, *[4] * counts):
        plane = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *(c.astype(np.int64) for c in out[1:])]


def _added(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    if not len(keys):
        return [keys, *counts]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return [keys[first], *(np.add.reduceat(c[order], first) for c in counts)]


class Gatherer:
    """Adds up keys and counts of a task; hands them on in runs, one a shard."""

    def __init__(self, shards: int, shard_of: Callable[[np.ndarray], np.ndarray], limit: int = GATHER) -> None:
        self.shards, self.shard_of, self.limit = shards, shard_of, limit
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append([keys, *counts])
        self.size += len(keys)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, *counts = _added(*(np.concatenate(x) for x in zip(*self.parts)))
            shard = self.shard_of(keys)
            order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
            ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
            for s in np.flatnonzero(np.diff(ends)):
                at = order[ends[s] : ends[s + 1]]
                run = _pack(keys[at], *(c[at] for c in counts))
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], type=pa.int32()), pa.array([run], type=pa.binary())], names=["shard", "run"])
        self.parts, self.size = [], 0


def _merged(parts: Iterator[pa.RecordBatch], counts: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each shard of a partition with its added-up keys."""
    runs: dict[int, list[bytes]] = {}
    for part in parts:
        for shard, run in zip(part.column("shard").to_pylist(), part.column("run").to_pylist()):
            runs.setdefault(shard, []).append(run)
    for shard in sorted(runs):
        yield shard, _added(*(np.concatenate(x) for x in zip(*(_unpack(r, counts) for r in runs.pop(shard)))))


def _range_of(shards: int) -> Callable[[np.ndarray], np.ndarray]:
    """Shards as ranges of the upper bits."""
    return lambda h: ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# --- the model -------------------------------------------------------------------------


class Model(NamedTuple):
    words: Shards  # hash, count
    pairs: Shards  # mixed key, count
    contexts: Shards  # followers once, twice, more often; preceding words
    tokens: int
    documents: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_free: float  # what the lower discounts set free

    @property
    def size(self) -> int:
        return self.words.total


class WordArray:
    """Numbers of words: places in the shards' sorted hashes; ``size`` for unknown ones."""

    def __init__(self, words: Shards) -> None:
        self.offsets, self.hashes = words.offsets, words.open("hash", "<u8")
        self.size, self.shard_of = words.total, _range_of(len(words.offsets) - 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        different, back = np.unique(hashes, return_inverse=True)
        shard = self.shard_of(different)
        out = np.full(len(different), self.size, dtype=np.int64)
        for s in np.unique(shard):
            low, high = np.searchsorted(shard, [s, s + 1])
            own = self.hashes[s]
            if len(own):
                at = np.minimum(np.searchsorted(own, different[low:high]), len(own) - 1)
                out[low:high] = np.where(own[at] == different[low:high], at + self.offsets[s], self.size)
        return out[back]


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney from how many entries have the count 1, 2, 3 and 4; between 0 and the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _tokens(words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Hashes of the tokens of the chosen rows, row bounds, and which tokens are a row's first."""
    counts = words.counts[rows] + 1
    bounds = np.r_[0, np.cumsum(counts)]
    out = np.full(bounds[-1], END, dtype=np.uint64)
    keep = np.ones(len(out), dtype=bool)
    keep[bounds[1:] - 1] = False
    chosen = np.zeros(len(words.counts), dtype=bool)
    chosen[rows] = True
    out[keep] = words.hashes[chosen[words.rows]]
    first = np.zeros(len(out), dtype=bool)
    first[bounds[:-1]] = True
    return out, bounds, first


def train(texts: DataFrame, folder: str) -> Model:
    """The model of rows of ``texts`` (text, teaches) that teach; its arrays are written to ``folder``."""
    shards = input_partitions(texts)

    def gather(parts: Iterator[pa.RecordBatch], found: Callable, gatherer: Gatherer) -> Iterator[pa.RecordBatch]:
        for part in parts:
            teaches = np.asarray(part.column("teaches"))
            for low, high, words in words_of(part.column("text"), SPACE_WORDS):
                rows = np.flatnonzero(teaches[low:high])
                if len(rows):
                    yield from gatherer.add(*found(*_tokens(words, rows)))
        yield from gatherer.flush()

    def merge(runs: DataFrame, write: Callable, counts: int) -> dict[int, list[int]]:
        def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, (keys, *sums) in _merged(parts, counts):
                said = write(shard, keys, *sums)
                yield pa.RecordBatch.from_arrays([pa.array([shard], type=pa.int32()), pa.array([[int(x) for x in said]], type=pa.list_(pa.int64()))], names=["shard", "said"])

        rows = runs.repartition(shards, "shard").mapInArrow(task, "shard int, said array<bigint>").collect()  # a row a shard
        found = {r["shard"]: r["said"] for r in rows}
        for s in set(range(shards)) - found.keys():
            found[s] = [int(x) for x in write(s, np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * counts)]
        return found

    # words
    def count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(tokens: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
            return np.unique(tokens, return_counts=True)

        return gather(parts, found, Gatherer(shards, _range_of(shards)))

    def write_words(shard: int, keys: np.ndarray, n: np.ndarray) -> list[int]:
        write_array(f"{folder}/hash-{shard}", keys.astype("<u8"))
        write_array(f"{folder}/count-{shard}", n.astype("<u8"))
        return [len(keys), n.sum(), n[keys == END].sum()]

    said = merge(texts.mapInArrow(count_words, RUN_SCHEMA), write_words, 1)
    words = Shards(folder, np.cumsum([0, *(said[s][0] for s in range(shards))]))
    tokens, documents = (sum(x[k] for x in said.values()) for k in (1, 2))
    base = words.total + 2  # numbers of words, of the unknown word and of the start
    if base >= 1 << 32:
        raise ValueError("pairs of more than 2^32 different words do not fit in 64 bits")

    # pairs: key = number of the first * base + number of the second
    def count_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordArray(words)

        def found(tokens: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
            own = known.numbers(tokens)
            before = np.where(first, base - 1, np.r_[0, own[:-1]])
            return np.unique(before.astype(np.uint64) * np.uint64(base) + own.astype(np.uint64), return_counts=True)

        ranges = _range_of(shards)
        return gather(parts, found, Gatherer(shards, lambda keys: ranges(mixed(keys))))

    def write_pairs(shard: int, keys: np.ndarray, n: np.ndarray) -> list[int]:
        order = np.argsort(hashes := mixed(keys))
        write_array(f"{folder}/pair-{shard}", hashes[order].astype("<u8"))
        write_array(f"{folder}/pair-count-{shard}", np.minimum(n[order], 0xFFFFFFFF).astype("<u4"))
        return [len(keys), *(int((n == k).sum()) for k in (1, 2, 3, 4))]

    said = merge(texts.mapInArrow(count_pairs, RUN_SCHEMA), write_pairs, 1)
    pairs = Shards(folder, np.cumsum([0, *(said[s][0] for s in range(shards))]))
    discounts = _discounts(np.sum([x[1:] for x in said.values()], axis=0))

    # contexts: by word number, followers met once, twice, more often, and preceding words
    def count_contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-base // shards)
        gatherer = Gatherer(shards, lambda keys: (keys // np.uint64(width)).astype(np.int64), GATHER // 2)
        for part in parts:
            for shard in part.column("shard").to_pylist():
                pair, n = map_array(f"{folder}/pair-{shard}", "<u8"), map_array(f"{folder}/pair-count-{shard}", "<u4")
                for low in range(0, len(pair), GATHER // 8):
                    own, times = unmixed(pair[low : low + GATHER // 8]), np.minimum(n[low : low + GATHER // 8], 3)
                    left, right = own // np.uint64(base), own % np.uint64(base)
                    none = np.zeros(len(own), dtype=np.int64)
                    first = [(times == k).astype(np.int64) for k in (1, 2, 3)]
                    yield from gatherer.add(*_added(np.r_[left, right], *(np.r_[f, none] for f in first), np.r_[none, none + 1]))
        yield from gatherer.flush()

    width = -(-base // shards)

    def write_contexts(shard: int, keys: np.ndarray, *sums: np.ndarray) -> list[int]:
        out = np.zeros((max(0, min(width, base - shard * width)), 4), dtype="<u8")
        out[(keys - np.uint64(shard * width)).astype(np.int64)] = np.stack(sums, axis=1)
        write_array(f"{folder}/context-{shard}", out.ravel())
        return [len(out), *(int((out[:, 3] == k).sum()) for k in (1, 2, 3, 4)), int((out[:, 3] > 2).sum())]

    numbers = texts.sparkSession.range(0, shards, 1, shards).select(F.col("id").cast("int").alias("shard"))
    said = merge(numbers.mapInArrow(count_contexts, RUN_SCHEMA), write_contexts, 4)
    contexts = Shards(folder, np.cumsum([0, *(said[s][0] for s in range(shards))]))
    found = np.sum([x[1:] for x in said.values()], axis=0)
    lower = _discounts(found[:4])
    free = float(np.dot(lower, [found[0], found[1], found[4]]))
    return Model(words, pairs, contexts, tokens, documents, discounts, lower, free)


class Scorer:
    """The model's arrays as a worker maps them."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, WordArray(model.words)
        self.counts = model.words.open("count", "<u8")
        self.pairs, self.pair_counts = model.pairs.open("pair", "<u8"), model.pairs.open("pair-count", "<u4")
        self.contexts = model.contexts.open("context", "<u8")
        self.shard_of = _range_of(len(self.pairs))
        self.lower_total = float(model.pairs.total)

    def _gathered(self, shards: list[np.ndarray], offsets: np.ndarray, numbers: np.ndarray, width: int = 1) -> np.ndarray:
        """Entries of sharded arrays; numbers are sorted."""
        out = np.zeros((len(numbers), width), dtype=np.int64)
        ends = np.searchsorted(numbers, offsets)
        for s in np.flatnonzero(np.diff(ends)):
            at = slice(ends[s], ends[s + 1])
            out[at] = shards[s].reshape(-1, width)[numbers[at] - offsets[s]]
        return out

    def token_counts(self, numbers: np.ndarray) -> np.ndarray:
        different, back = np.unique(numbers, return_inverse=True)
        return self._gathered(self.counts, self.model.words.offsets, different)[:, 0][back]

    def pair_count(self, keys: np.ndarray) -> np.ndarray:
        different, back = np.unique(mixed(keys), return_inverse=True)
        ends = np.searchsorted(self.shard_of(different), np.arange(len(self.pairs) + 1))
        out = np.zeros(len(different), dtype=np.int64)
        for s in np.flatnonzero(np.diff(ends)):
            own, asked = self.pairs[s], different[ends[s] : ends[s + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                out[ends[s] : ends[s + 1]] = np.where(own[at] == asked, self.pair_counts[s][at], 0)
        return out[back]

    def log10(self, own: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 p(own | before) for word numbers; the start is ``size + 1``, unknown is ``size``."""
        model = self.model
        base = model.size + 2
        numbers, back = np.unique(np.r_[own, before], return_inverse=True)
        facts = self._gathered(self.contexts, model.contexts.offsets, numbers, 4)
        preceding = facts[:, 3]
        uniform = 1.0 / (model.size + 1)
        if not self.lower_total:
            return np.full(len(own), np.log10(uniform))
        p = (preceding - _discount(preceding, model.lower)) / self.lower_total + model.lower_free / self.lower_total * uniform
        total = self._gathered(self.counts, model.words.offsets, numbers)[:, 0]
        total[numbers == base - 1] = model.documents
        free = facts[:, :3] @ np.array(model.discounts)
        own_p, u = p[back[: len(own)]], back[len(own) :]
        n = self.pair_count(before.astype(np.uint64) * np.uint64(base) + own.astype(np.uint64))
        seen = total[u] > 0
        scale = np.where(seen, total[u], 1)
        return np.log10(np.where(seen, (n - _discount(n, model.discounts)) / scale + free[u] / scale * own_p, own_p))


def scored(docs: DataFrame, teaches: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches"))
    model = train(texts.select("text", "teaches"), fresh_path(docs.sparkSession, "ngrams"))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, v, n = Scorer(model), model.size, model.tokens
        for part in parts:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for low, high, words in words_of(part.column("text"), SPACE_WORDS):
                tokens, bounds, first = _tokens(words, np.arange(high - low))
                own = scorer.words.numbers(tokens)
                before = np.where(first, v + 1, np.r_[0, own[:-1]])
                counts = scorer.token_counts(own)
                row = np.repeat(np.arange(high - low), np.diff(bounds))
                base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                add = lambda values: np.bincount(row, weights=values, minlength=high - low)  # noqa: E731, B023
                for column, values in zip(columns, (np.diff(bounds), add(counts > 0).astype(np.int64), add(base), add(scorer.log10(own, before)))):
                    column.append(values)
            kinds = (np.int64, np.int64, np.float64, np.float64)
            size, known, base, score = (np.concatenate([np.zeros(0, dtype=k), *c]) for k, c in zip(kinds, columns))
            held = pa.array(~np.asarray(part.column("teaches")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), held, pa.array(size), pa.array(known), pa.array(np.full(part.num_rows, n)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = dict(docs.dtypes)[doc_id]
    return texts.mapInArrow(scan, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
