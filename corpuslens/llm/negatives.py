"""Hard negatives for anchors of an embedding table, by LEMP-style pruned inner-product search.

Rows are put into length buckets: ranges of the norm, cut by a range partitioning on the norm
into pieces of about ``RANGE_VALUES`` components, each piece cut into buckets of at most
``BUCKET`` rows, longest first, with the order of the rows by each normalised coordinate.
Anchors are put into blocks of about ``ANCHORS``. Every block meets every bucket once a phase
(the stated query set against all rows, in blocks): a task has one block, gets a share of the
buckets one by one and keeps each anchor's first rows of those it has seen. Neither is shuffled
or broadcast for that, and what a task emits doesn't grow with its buckets. An anchor ``q``
needing scores of at least ``t`` skips a bucket whose longest row has ``|q| * L < t``. Otherwise
the rows that can reach ``t`` have, for each of its ``FOCUS`` largest coordinates ``f``, a
normalised value in the range that ``q/|q| . p/|p| >= t / (|q| L)`` allows: ``[qf t' - s, qf t' + s]``
with ``s = sqrt((1 - qf^2)(1 - t'^2))``. Where a sample of the bucket says that the narrowest
range holds few rows, the range is taken from the sorted list, intersected with the others, and
what is left is verified by its exact integer inner product. Where the ranges prune little or
``t`` is not positive, the bucket is scanned by a product of matrices, in floating point only
where that is exact. The sample decides on time, never on rows.

Phase 1 finds each anchor's positives: its first ``POSITIVES`` other rows of the same label by
score (higher first, ties by smaller ``vec_id``); ``t`` is the score of the fifth best row seen.
Phase 2 finds, for each anchor and positive of score ``ps``, the first ``NEGATIVES`` rows of
another label with ``30 ps <= 100 ns <= 90 ps``; ``t`` is the least, over the anchor's positives,
of the lower bound and the tenth best row seen. What tasks keep is merged by a window with a
limit, which Spark applies before its shuffle.

Definitions: rows with a null label, a null vector, or a null or non-finite component take no
part; rows equal in every column count once; a row is another row when its (vec_id, label,
vector) differs; missing components of shorter vectors count as zero; null ``vec_id`` sorts
last among ties and is never an anchor; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import stored

#: fixed values of the contract
ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90

BUCKET = 4096  # at most 65536: places in a bucket are 16 bits
ANCHORS = 4096
FOCUS = 3
SEED = 64  # rows scored first where an anchor has too few, to set its threshold
#: components of a range of norms. Spark samples 300 keys a range for the driver, so ranges
#: are as large as a task can hold, but FEW of them where the table allows.
RANGE_VALUES, FEW = 1 << 22, 64
#: shares of the buckets that a block meets at once, so that about TASKS tasks run
SHARES, TASKS = (2, 16), 256
#: a range is looked up where it holds less than NARROW of SAMPLE rows of the bucket
NARROW, SAMPLE = 1 / 8, 64
#: anchors scanned for at once, pairs looked up and components multiplied at once
TILE, PAIRS, VALUES = 256, 1 << 18, 1 << 22
#: sums are exact in single and double precision below these
SINGLE, EXACT = float(1 << 23), float(1 << 52)
#: score and id of what isn't there
LEAST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BUCKET_ROW = "rids binary, vec_ids binary, null_ids binary, labels binary, norms binary, bytes int, vecs binary, orders binary"
BLOCK_ROW = "block int, a_rids binary, a_vec_ids binary, a_labels binary, a_norms binary, a_bytes int, a_vecs binary, p_rids binary, p_ids binary, p_nulls binary, p_scores binary"


def prepared(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: label shifted, components as integers, norm; ``rid`` names a row."""
    e = F.col("embedding")
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
    valid = F.col("label").isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, finite), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), e.alias("embedding")).where(valid)
    rows = rows.dropDuplicates(["vec_id", "label", "embedding"])
    label = F.when(F.coalesce(F.col("vec_id") % SHIFT_EVERY == 0, F.lit(False)), (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vec = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = rows.select("vec_id", label.alias("label"), vec.alias("vec"))
    rows = rows.select("vec_id", "label", "vec", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)).alias("norm"))
    # ``rid`` is fixed once written, so that retried tasks see the same names
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "norm", "vec"), "negatives-rows")


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _matrix(vecs: list | np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), dtype=np.int64)
    if isinstance(vecs, np.ndarray):
        out[:, : vecs.shape[1]] = vecs
    else:
        for i, v in enumerate(vecs):
            out[i, : len(v)] = v
    return out


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled with zeros, in the narrowest type."""
    column = column.combine_chunks()
    lengths, values = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= out.min(initial=0) and out.max(initial=0) <= np.iinfo(t).max))


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integers with the greatest for nulls, and which are null."""
    return pc.fill_null(column, int(LAST)).to_numpy().astype(np.int64), pc.is_null(column).to_numpy(zero_copy_only=False)


def _units(vecs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return vecs / np.where(norms > 0, norms, 1.0)[:, None]


def _bucketed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one norm range as buckets of at most ``size``, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("norm", pa.float64()), ("vec", pa.list_(pa.int64()))]))
        if not table.num_rows:
            return
        table = table.sort_by([("norm", "descending"), ("rid", "ascending")])
        for low in range(0, table.num_rows, size):
            piece = table.slice(low, size)
            vecs, norms, (vec_ids, null_ids) = _dense(piece.column("vec")), piece.column("norm").to_numpy(), _numbers(piece.column("vec_id"))
            orders = np.argsort(_units(vecs, norms).T, axis=1, kind="stable").astype(np.uint16)
            parts = {"rids": piece.column("rid").to_numpy(), "vec_ids": vec_ids, "null_ids": null_ids, "labels": piece.column("label").to_numpy().astype(np.int64), "norms": norms, "vecs": vecs, "orders": orders}
            row = {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()} | {"bytes": pa.array([vecs.itemsize], pa.int32())}
            yield pa.RecordBatch.from_pydict({k: row[k] for k in _names(BUCKET_ROW)})

    return run


class Bucket:
    """A length bucket: rows, longest first, and for each coordinate their order by its normalised value."""

    def __init__(self, rids: list, vec_ids: list, labels: list, norms: list, vecs: list, width: int, null_ids: np.ndarray | None = None, orders: np.ndarray | None = None) -> None:
        self.rids, self.labels = np.asarray(rids, dtype=np.int64), np.asarray(labels, dtype=np.int64)
        self.null_ids = np.array([v is None for v in vec_ids], dtype=bool) if null_ids is None else null_ids
        self.vec_ids = np.array([LAST if v is None else v for v in vec_ids], dtype=np.int64) if null_ids is None else vec_ids
        self.norms = np.asarray(norms, dtype=np.float64)
        self.vecs = _matrix(vecs, width) if isinstance(vecs, list) else vecs
        self.longest = float(self.norms.max()) if len(self.norms) else 0.0
        self.orders, self.lists = orders, None

    def unit(self) -> np.ndarray:
        """By coordinate: the normalised value of each row."""
        if self.lists is None:
            unit = np.ascontiguousarray(_units(self.vecs, self.norms).T)
            order = np.argsort(unit, axis=1, kind="stable") if self.orders is None else self.orders
            self.lists = unit, order, np.take_along_axis(unit, order.astype(np.int64), axis=1)
        return self.lists[0]

    def feasible(self, anchors: Anchors, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest normalised value, by anchor and focus coordinate, of a row that scores ``least``."""
        u = anchors.unit_focus[at]
        t = np.minimum(1.0, least / (anchors.norms[at] * self.longest))[:, None]
        s = np.sqrt(np.maximum(0.0, (1 - u**2) * (1 - t * t)))
        # the cap's projection: all of [-1, 1] on a side where the coordinate's own axis lies within it
        return np.where(-u > t, -1.0, u * t - s) - 1e-9, np.where(u >= t, 1.0, u * t + s) + 1e-9

    def narrow(self, anchors: Anchors, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the narrowest range seems to hold few rows, by a sample."""
        rows = np.linspace(0, len(self.rids) - 1, min(SAMPLE, len(self.rids))).astype(np.int64)
        x = _units(self.vecs[rows], self.norms[rows])[:, anchors.focus[at]]
        return ((x >= low) & (x <= high)).mean(axis=0).min(axis=1, initial=1.0) < NARROW

    def ranged(self, anchors: Anchors, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an anchor and a row within the ranges of all its focus coordinates."""
        unit = self.unit()
        _, order, values = self.lists
        focus = anchors.focus[at]
        a, b = np.zeros(focus.shape, dtype=np.int64), np.zeros(focus.shape, dtype=np.int64)
        for f in np.unique(focus):
            here = focus == f
            a[here], b[here] = np.searchsorted(values[f], low[here], side="left"), np.searchsorted(values[f], high[here], side="right")
        best = np.argmin(b - a, axis=1)
        each = np.arange(len(at))
        first, count, of = a[each, best], np.maximum(0, (b - a)[each, best]), focus[each, best]
        ends = np.cumsum(count)
        i = 0
        while i < len(at):
            to = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
            n = count[i:to]
            k = np.repeat(np.arange(i, to), n)
            rows = order[of[k], first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
            for f in range(focus.shape[1]):
                x = unit[focus[k, f], rows]
                keep = (x >= low[k, f]) & (x <= high[k, f])
                k, rows = k[keep], rows[keep]
            yield at[k], rows
            i = to

    def candidates(self, q: np.ndarray, qnorm: float, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more with ``q``; None where nothing can be pruned."""
        if least <= 0 or qnorm == 0:
            return None
        if qnorm * self.longest < least * (1 - 1e-12):
            return np.zeros(0, dtype=np.int64)
        anchors, at = Anchors(np.asarray(q)[None, :], np.array([qnorm])), np.zeros(1, dtype=np.int64)
        return np.sort(np.concatenate([rows for _, rows in self.ranged(anchors, at, *self.feasible(anchors, at, np.array([least])))]))


class Anchors:
    """Vectors of a block of anchors with their largest coordinates."""

    def __init__(self, vecs: np.ndarray, norms: np.ndarray) -> None:
        self.vecs, self.norms = vecs, norms
        unit = _units(vecs, norms)
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.unit_focus = np.take_along_axis(unit, self.focus, axis=1)


class Best:
    """The first ``k`` of each slot so far: higher score, then smaller vec_id, nulls last, then rid."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.fields = [np.full((slots, k), LEAST), np.ones((slots, k), dtype=bool), np.full((slots, k), LAST), np.full((slots, k), LAST)]

    def least(self) -> np.ndarray:
        return self.fields[0][:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, bucket: Bucket, rows: np.ndarray) -> None:
        new = [score, bucket.null_ids[rows], bucket.vec_ids[rows], bucket.rids[rows]]
        s, n, v, r = (x[slot, -1] for x in self.fields)
        keep = (new[0] > s) | ((new[0] == s) & ((new[1] < n) | ((new[1] == n) & ((new[2] < v) | ((new[2] == v) & (new[3] < r))))))
        if not keep.any():
            return
        slot, new = slot[keep], [x[keep] for x in new]
        at = np.unique(slot)
        slot = np.concatenate([np.repeat(at, self.k), slot])
        score, null, vec, rid = (np.concatenate([x[at].ravel(), y]) for x, y in zip(self.fields, new))
        order = np.lexsort((rid, vec, null, ~score, slot))
        first = np.searchsorted(slot[order], at)
        order = order[first[:, None] + np.arange(self.k)]
        for x, y in zip(self.fields, (score, null, vec, rid)):
            x[at] = y[order]


class Block:
    """A block of anchors and what it has found: positives (phase 1), or negatives of each positive."""

    def __init__(self, row: dict, phase: int) -> None:
        self.phase, self.rids, self.vec_ids, self.labels = phase, *(np.frombuffer(row[k], np.int64) for k in ("a_rids", "a_vec_ids", "a_labels"))
        n = len(self.rids)
        vecs = np.frombuffer(row["a_vecs"], f"i{row['a_bytes']}").reshape(n, -1)
        self.anchors = Anchors(vecs, np.frombuffer(row["a_norms"], np.float64))
        if phase == 1:
            self.best = Best(n, POSITIVES)
            return
        self.p_rids, self.p_ids, self.p_scores = (np.frombuffer(row[k], np.int64).reshape(n, POSITIVES) for k in ("p_rids", "p_ids", "p_scores"))
        self.p_nulls = np.frombuffer(row["p_nulls"], bool).reshape(n, POSITIVES)
        self.best = Best(n * POSITIVES, NEGATIVES)
        # of whole scores: 30 ps <= 100 ns <= 90 ps; nothing where there is no positive or its score is negative
        some = (self.p_rids != LAST) & (self.p_scores >= 0)
        tens, ones = np.divmod(np.where(some, self.p_scores, 0), 100)
        self.low, self.high = np.where(some, LOW * tens - (-LOW * ones) // 100, 1), np.where(some, HIGH * tens + (HIGH * ones) // 100, 0)

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that is of use to these anchors; ``LAST`` as least where none is."""
        if self.phase == 1:
            return self.best.least()[at], np.full(len(at), LAST)
        low, high = np.maximum(self.low[at], self.best.least().reshape(self.low.shape)[at]), self.high[at]
        some = low <= high
        return np.where(some, low, LAST).min(axis=1), np.where(some, high, LEAST).max(axis=1)

    def offer(self, bucket: Bucket, at: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        same = bucket.labels[rows] == self.labels[at]
        if self.phase == 1:
            same &= bucket.rids[rows] != self.rids[at]
            self.best.offer(at[same], scores[same], bucket, rows[same])
            return
        at, rows, scores = at[~same], rows[~same], scores[~same]
        k, p = np.nonzero((self.low[at] <= scores[:, None]) & (scores[:, None] <= self.high[at]))
        self.best.offer(at[k] * POSITIVES + p, scores[k], bucket, rows[k])

    def meet(self, bucket: Bucket) -> None:
        anchors = self.anchors
        width = max(bucket.vecs.shape[1], anchors.vecs.shape[1])
        if bucket.vecs.shape[1] != width:
            bucket = Bucket(bucket.rids, bucket.vec_ids, bucket.labels, bucket.norms, _matrix(bucket.vecs, width), width, bucket.null_ids)
        if anchors.vecs.shape[1] != width:
            self.anchors = anchors = Anchors(_matrix(anchors.vecs, width), anchors.norms)
        # no sum of some of a product's terms is larger than the product of the norms
        largest = float(anchors.norms.max(initial=0)) * bucket.longest
        kind = np.float32 if largest < SINGLE else np.float64 if largest < EXACT else np.int64
        q, p = anchors.vecs.astype(kind), bucket.vecs.astype(kind)

        least, _ = self.bounds(np.arange(len(self.rids)))
        some = least != LAST
        some &= (least <= 0) | (anchors.norms * bucket.longest >= least * (1 - 1e-12))
        ask = np.flatnonzero(some & (least > 0) & (anchors.norms > 0))
        if len(ask):
            low, high = bucket.feasible(anchors, ask, least[ask])
            few = bucket.narrow(anchors, low, high, ask)
            some[ask[few]] = False
            if few.any():
                step = max(1, VALUES // width)
                for at, rows in bucket.ranged(anchors, ask[few], low[few], high[few]):
                    for i in range(0, len(at), step):
                        k, r = at[i : i + step], rows[i : i + step]
                        self.offer(bucket, k, r, np.einsum("ij,ij->i", q[k], p[r]).astype(np.int64))
        self.scan(bucket, np.flatnonzero(some), q, p)

    def scan(self, bucket: Bucket, at: np.ndarray, q: np.ndarray, p: np.ndarray) -> None:
        """Scores of the anchors with the rows whose label is of use, those above the bounds offered."""
        if self.phase == 1:
            groups = [(at[self.labels[at] == x], np.flatnonzero(bucket.labels == x)) for x in np.unique(self.labels[at])]
        else:
            groups = [(at, np.arange(len(bucket.rids)))] if len(at) else []
        for own, rows in groups:
            for i in range(0, len(own), TILE):
                part = own[i : i + TILE]
                short = self.best.least().reshape(len(self.rids), -1)[part].min() == LEAST
                cuts = [0, SEED, 8 * SEED, len(rows)] if short else [0, len(rows)]
                for a, b in zip(cuts, cuts[1:]):
                    own_rows = rows[a:b]
                    if not len(own_rows):
                        continue
                    least, most = self.bounds(part)
                    scores = q[part] @ (p if len(own_rows) == len(p) else p[own_rows]).T
                    found = np.flatnonzero(scores >= least.astype(q.dtype)[:, None])
                    k, r = np.divmod(found, len(own_rows))
                    scores = scores.ravel()[found].astype(np.int64)
                    use = scores <= most[k]
                    self.offer(bucket, part[k[use]], own_rows[r[use]], scores[use])

    def found(self) -> pa.RecordBatch:
        score, null, vec, rid = self.best.fields
        slot, k = np.nonzero(rid != LAST)
        a, p = (slot, None) if self.phase == 1 else np.divmod(slot, POSITIVES)
        none = pa.nulls(len(slot), pa.int64())
        columns = {
            "anchor_rid": pa.array(self.rids[a]), "anchor_id": pa.array(self.vec_ids[a]),
            "positive_rid": none if p is None else pa.array(self.p_rids[a, p]),
            "positive_id": none if p is None else pa.array(self.p_ids[a, p], mask=self.p_nulls[a, p]),
            "positive_score": none if p is None else pa.array(self.p_scores[a, p]),
            "rid": pa.array(rid[slot, k]), "vec_id": pa.array(vec[slot, k], mask=null[slot, k]), "score": pa.array(score[slot, k]),
        }
        return pa.RecordBatch.from_pydict(columns)


def _pairs(phase: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with the buckets they meet, one by one; then what the blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        for batch in batches:
            number = batch.column("block")
            for i in range(batch.num_rows):
                name = number[i].as_py()
                if name not in blocks:
                    blocks[name] = Block({k: batch.column(k)[i].as_py() for k in _names(BLOCK_ROW)}, phase)
                blocks[name].meet(_read_bucket({k: batch.column(k)[i] for k in _names(BUCKET_ROW) if k in batch.schema.names}))
        for block in blocks.values():
            yield block.found()

    return run


def _read_bucket(row: dict) -> Bucket:
    of = lambda k, kind: np.frombuffer(row[k].as_buffer(), kind)
    rids = of("rids", np.int64)
    vecs = of("vecs", f"i{row['bytes'].as_py()}").reshape(len(rids), -1)
    orders = of("orders", np.uint16).reshape(-1, len(rids)) if "orders" in row else None
    return Bucket(rids, of("vec_ids", np.int64), of("labels", np.int64), of("norms", np.float64), vecs, vecs.shape[1], of("null_ids", bool), orders)


PAIR_ROW = "anchor_rid long, anchor_id long, positive_rid long, positive_id long, positive_score long, rid long, vec_id long, score long"


def _block(group: pa.Table) -> pa.Table:
    """Anchors of one block as one row; ``p`` has up to ``POSITIVES`` rows of each."""
    vecs = _dense(group.column("vec"))
    p = {k: np.full((len(vecs), POSITIVES), LAST) for k in ("p_rids", "p_ids", "p_scores")} | {"p_nulls": np.zeros((len(vecs), POSITIVES), dtype=bool)}
    for k, name in (("p_rids", "rid"), ("p_ids", "vec_id"), ("p_scores", "score")):
        for i, own in enumerate(group.column("p").to_pylist()):
            for j, x in enumerate(own):
                p["p_nulls"][i, j] |= x[name] is None
                p[k][i, j] = LAST if x[name] is None else x[name]
    parts = {"a_rids": group.column("rid").to_numpy(), "a_vec_ids": group.column("vec_id").to_numpy(), "a_labels": group.column("label").to_numpy().astype(np.int64), "a_norms": group.column("norm").to_numpy(), "a_vecs": vecs} | p
    if not sum(map(len, group.column("p").to_pylist())):  # phase 1: not sent to every bucket
        parts |= dict.fromkeys(p, np.zeros(0))
    row = {k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}
    row |= {"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "a_bytes": pa.array([vecs.itemsize], pa.int32())}
    return pa.table({k: row[k] for k in _names(BLOCK_ROW)})


def _met(buckets: DataFrame, anchors: DataFrame, count: int, phase: int) -> DataFrame:
    """What every block finds in its shares of the buckets; each task reads its share from storage."""
    n = max(1, -(-count // ANCHORS))
    numbered = anchors.select(F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int").alias("block"), "rid", "vec_id", "label", "norm", "vec", "p")
    blocks = stored(numbered.groupBy("block").applyInArrow(_block, BLOCK_ROW), "negatives-blocks")
    shares = buckets.coalesce(min(SHARES[1], max(SHARES[0], -(-TASKS // n))))
    # nested loops without a broadcast: a task has one share and one block
    pairs = shares.hint("shuffle_replicate_nl").crossJoin(blocks.repartitionByRange(n, "block"))
    return pairs.mapInArrow(_pairs(phase), PAIR_ROW)


def _first_per(rows: DataFrame, by: list[str], k: int, order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = prepared(embeddings)
    is_anchor = F.coalesce(F.col("vec_id") % ANCHOR_EVERY == 0, F.lit(False))
    n_rows, n_values, n_anchors = rows.agg(F.count("*"), F.sum(F.size("vec").cast("long")), F.count_if(is_anchor)).first()
    if not n_rows:
        return embeddings.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ranges = min(-(-n_rows // BUCKET), max(FEW, -(-n_values // RANGE_VALUES)))
    ranged = rows.repartitionByRange(ranges, F.col("norm").desc(), "rid")
    buckets = stored(ranged.mapInArrow(_bucketed(BUCKET), BUCKET_ROW), "negatives-buckets")
    anchors = rows.where(is_anchor)
    by_score = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("rid")]

    none = F.array().cast("array<struct<rank:int,rid:long,vec_id:long,score:long>>")
    first = _met(buckets, anchors.withColumn("p", none), n_anchors, 1)
    positives = stored(_first_per(first, ["anchor_rid"], POSITIVES, by_score), "negatives-positives")
    listed = positives.groupBy("anchor_rid").agg(F.array_sort(F.collect_list(F.struct("rank", "rid", "vec_id", "score"))).alias("p"))
    # both sides grow with the input: merged, never broadcast
    with_positives = anchors.join(listed.hint("merge"), anchors["rid"] == listed["anchor_rid"]).drop("anchor_rid")
    # where ranges are of use with these lower thresholds, a task sorts for itself
    second = _met(buckets.drop("orders"), with_positives, n_anchors, 2)
    chosen = _first_per(second, ["anchor_rid", "positive_rid"], NEGATIVES, by_score)
    return chosen.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
