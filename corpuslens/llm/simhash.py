"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verified Hamming distance.

A fingerprint of 64 bits is cut into ``m`` blocks. Two fingerprints that differ in at most
``d`` bits agree in at least ``m - d`` blocks, so they meet under the key of some choice of
``m - d`` blocks. ``m`` is chosen by expected cost: more blocks make more keys a fingerprint
but longer, more selective keys. All choices give the same, exact links.

* Equal fingerprints are one node, so copies of a text never meet each other.
* Keys that many fingerprints share are split into cells of bounded size: the key's
  fingerprints fall into hash parts and each pair of parts is a cell.
* A cell yields links that connect what it has, not all its pairs: each fingerprint is linked
  with the first that it reaches by near steps within the cell.

Result for odd input: null, empty and blank texts have fingerprint zero, and are linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows are repeated in
the result; a component without any id has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import mixed, row_key, stored, texts_of
from corpuslens.llm.components import components

#: A cell holds about so many fingerprints; above PAIRS, a walk replaces comparing each with its successors.
CELL, PAIRS = 4096, 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the text's word shingles."""
    return majorities(text, words, 1, seed)[0]


def shingles(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's word shingles, in order; a text of fewer words is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    words = min(words, len(parts))
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.r_[0, ends[:-words]].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(ends))


def _majorities(hashes: np.ndarray, longs: int) -> list[int]:
    ones, n = np.zeros((longs, 64), dtype=np.int64), len(hashes)
    for low in range(0, n, 65536):
        h = hashes[low : low + 65536]
        for k in range(longs):
            own = mixed(h ^ np.uint64(k)) if k else h
            ones[k] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(row * 2 > n).tobytes(), "big") for row in ones]


def majorities(text: bytes, words: int = 4, longs: int = 1, seed: int = 42) -> list[int]:
    """``longs`` fingerprints of a text: the one of its shingles' XXH64, and of further hashes made of that."""
    return _majorities(shingles(text, words, seed), longs)


def _names(longs: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, longs))]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, longs: int = 1) -> DataFrame:
    """(doc_id, row_key, fp, fp1, ...): the fingerprints of each row as signed longs."""
    kind = dict(docs.dtypes)[doc_id]
    names = _names(longs)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([majorities(t, words, longs) for t in texts_of(part.column("text"))], dtype=np.uint64).reshape(-1, longs)
            columns = [pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(longs)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), *columns], names=["doc_id", "row_key", *names])

    taken = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).cast("string").alias("text")
    )
    return taken.mapInArrow(scan, f"doc_id {kind}, row_key string, " + ", ".join(f"{n} bigint" for n in names))


def block_masks(n: int, distance: int, blocks: int | None = None) -> list[int]:
    """Masks of block choices; the number of blocks is given, or the cheapest for ``n`` fingerprints.

    Cost: rows under keys, and pairs that meet by chance; both in rows.
    """

    def cost(m: int) -> float:
        return comb(m, distance) * (n + n * n / 2 / 2 ** (64 * (m - distance) // m))

    m = blocks or min(range(distance + 1, distance + 6), key=cost)
    edges = [round(64 * i / m) for i in range(m + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(each, m - distance)]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of longs differ in at most ``distance`` bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= distance


def _walk(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """(first, other) of what is connected among sorted ``fps`` by steps of at most ``distance`` bits."""
    rest = fps
    while len(rest) > 1:
        first = int(rest[:1, 0].view(np.int64)[0])
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            near = _near(rest, queue.pop(), distance)
            if near.any():
                reached = rest[near]
                queue.extend(reached)
                rest = rest[~near]
                yield from ((first, int(x)) for x in reached[:, 0].view(np.int64))


def _links(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``cells``: from the first of what is connected there to each other."""
    cut = np.flatnonzero(np.diff(cells)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(cells)]
    sizes = ends - starts
    small = np.repeat(sizes <= PAIRS, sizes)
    near: list[np.ndarray] = [np.zeros((2, 0), dtype=np.int64)]
    for step in range(1, min(PAIRS, int(sizes.max(initial=0)))):
        i = np.flatnonzero((cells[:-step] == cells[step:]) & small[:-step])
        i = i[_near(fps[i], fps[i + step], distance)]
        near.append(np.stack([i, i + step]))
    i, j = np.concatenate(near, axis=1)
    first = np.arange(len(fps))
    while (first[i] != first[j]).any():
        least = np.minimum(first[i], first[j])
        np.minimum.at(first, i, least)
        np.minimum.at(first, j, least)
    other = np.flatnonzero(first != np.arange(len(fps)))
    left, right = [fps[first[other], 0].view(np.int64)], [fps[other, 0].view(np.int64)]
    for k in np.flatnonzero(sizes > PAIRS):
        found = np.array(list(_walk(fps[starts[k] : ends[k]], distance)), dtype=np.int64).reshape(-1, 2)
        left.append(found[:, 0])
        right.append(found[:, 1])
    return np.concatenate(left), np.concatenate(right)


def near_links(
    fps: DataFrame, distance: int = 4, blocks: int | None = None, block_distance: int | None = None, keyed_longs: int | None = None
) -> DataFrame:
    """(a, b): links of ``fps`` (fp, fp1 ..., distinct by fp) that differ in at most ``distance`` bits in all.

    Each of the first ``keyed_longs`` longs, by default of all, is cut into blocks by itself. Keys
    are made for ``block_distance`` differing bits in one long, by default ``distance``; with a
    single long that yields all links. All longs count in the distance.
    """
    names = fps.columns
    masks = block_masks(0 if blocks else fps.count(), distance if block_distance is None else block_distance, blocks)
    signed = [(c, m - (1 << 64) if m >> 63 else m) for c in names[:keyed_longs] for m in masks]
    key = lambda i, c, m: F.xxhash64(F.lit(i), F.col(c).bitwiseAND(F.lit(m)))
    keyed = fps.select(*names, F.explode(F.array(*[key(i, c, m) for i, (c, m) in enumerate(signed)])).alias("key"))
    parts = F.ceil(F.col("n") / F.lit(CELL // 2)).cast("int")
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("key", parts.alias("parts")), "hot-keys")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.when(F.col("parts").isNull(), F.array("key")).otherwise(
        F.transform(others, lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    )
    dealt = keyed.join(hot, "key", "left").select(*names, F.explode(cells).alias("cell"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = fps = None
        for part in batches:
            more = np.asarray(part.column("cell")), np.stack([np.asarray(part.column(c)).view(np.uint64) for c in names], axis=1)
            cells, fps = (np.concatenate(x) for x in zip((cells, fps), more)) if cells is not None else more
            if len(cells) and cells[0] != cells[-1]:  # the last cell may go on in the next batch
                to = int(np.flatnonzero(cells != cells[-1])[-1]) + 1
                a, b = _links(cells[:to], fps[:to], distance)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                cells, fps = cells[to:], fps[to:]
        if cells is not None and len(cells):
            a, b = _links(cells, fps, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = dealt.repartition("cell").sortWithinPartitions("cell", "fp")
    return ordered.mapInArrow(scan, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4,
    blocks: int | None = None, longs: int = 1, block_distance: int | None = None, keyed_longs: int | None = None,
) -> DataFrame:
    """(doc_id, row_key, fp, component_id, first_key) of each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``first_key`` the smallest
    (id, row key) there: the row that stands for the component.
    """
    rows = stored(fingerprints(docs, doc_id, text, words, longs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    more = [F.min(F.struct(*_names(longs)[1:])).alias("more")] if longs > 1 else []
    fps = stored(rows.groupBy("fp").agg(first, *more).select("fp", "first", *(["more.*"] if more else [])), "distinct-fingerprints")
    labels = components(near_links(fps.select(*_names(longs)), distance, blocks, block_distance, keyed_longs))
    joined = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    joined = stored(joined, "fingerprint-labels")
    leads = joined.groupBy("label").agg(F.min("first").alias("lead"))
    leads = stored(joined.join(leads, "label").select("fp", F.col("lead.doc_id").alias("component_id"), F.col("lead.row_key").alias("first_key")), "fingerprint-components")
    return rows.join(leads, "fp").select("doc_id", "row_key", "fp", "component_id", "first_key")


# --- near-duplicates by exact similarity -------------------------------------------------

#: A pair of similarity 0.8 agrees in all four least hashes of one of 24 bands but for 3 times in a million.
BANDS, ROWS, LONGS = 24, 4, 6
#: How many candidates of other components each text of a large cell has in the rounds; in the last all.
ROUNDS = (4, 64, None)
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least values of its hash functions over the shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(distinct), 4096):
            np.minimum(least, (distinct[low : low + 4096] * _FACTORS[:, None]).min(axis=1), out=least)
        for row in least.reshape(BANDS, ROWS).T:
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + row)
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, given as distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _set_nodes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, node, fp, fp1, ..., keys): ``node`` names the set of shingles, equal for equal sets."""
    names = _names(LONGS)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, prints, keys = [], [], []
            for t in texts_of(part.column("text")):
                own = np.unique(shingles(t, words))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                prints.append(_majorities(own, LONGS))
                keys.append(band_keys(own).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64))
            found = np.array(prints, dtype=np.uint64).reshape(-1, LONGS)
            columns = [np.array(nodes, dtype=np.uint64), *(np.ascontiguousarray(found[:, k]) for k in range(LONGS))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), *(pa.array(c.view(np.int64)) for c in columns), pa.array(keys, type=pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "node", *names, "keys"],
            )

    taken = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    longs = ", ".join(f"{n} bigint" for n in names)
    return taken.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, row_key string, node bigint, {longs}, keys array<bigint>")


def _steps(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Places (i, j): steps of at most ``distance`` bits that span what such steps connect."""
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        for i in queue:  # grows while it is read
            near = _near(fps[rest], fps[i], distance)
            yield from ((i, j) for j in rest[near])
            queue.extend(rest[near])
            rest = rest[~near]


def _cell_pairs(fps: np.ndarray, distance: int, labels: np.ndarray | None, most: int | None) -> Iterator[tuple[int, int]]:
    """Places (i, j) of near pairs of one cell: all of a small cell; else steps that span it or, given ``labels``, the nearest pairs between labels."""
    n = len(fps)
    if labels is None and n > PAIRS:
        yield from _steps(fps, distance)
        return
    if labels is not None and (labels == labels[0]).all():
        return
    for i in range(n):
        others = np.arange(i + 1, n) if labels is None else np.flatnonzero(labels != labels[i])
        bits = np.bitwise_count(fps[others] ^ fps[i]).sum(axis=-1, dtype=np.int32)
        near = bits <= distance
        others, bits = others[near], bits[near]
        if labels is not None and most is not None and len(others) > most:
            others = others[np.argsort(bits, kind="stable")[:most]]
        yield from ((i, j) for j in others)


def _pairs(cells: DataFrame, distance: int, most: int | None = None) -> DataFrame:
    """(a, b), a < b: candidate pairs of ``cells`` (cell, node, fp, fp1, ..., and label after the first round)."""
    names, labelled = _names(LONGS), "label" in cells.columns

    def found(cell: np.ndarray, node: np.ndarray, fps: np.ndarray, label: np.ndarray | None) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(cell)) + 1
        pairs: set[tuple[int, int]] = set()
        for low, high in zip(np.r_[0, cut].tolist(), np.r_[cut, len(cell)].tolist()):
            if high - low > 1:
                own = node[low:high]
                for i, j in _cell_pairs(fps[low:high], distance, None if label is None else label[low:high], most):
                    a, b = int(own[i]), int(own[j])
                    if a != b:
                        pairs.add((min(a, b), max(a, b)))
        out = np.array(list(pairs), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in (0, 1)], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            more = [np.asarray(part.column("cell")), np.asarray(part.column("node")), np.stack([np.asarray(part.column(c)).view(np.uint64) for c in names], axis=1)]
            more += [np.asarray(part.column("label"))] if labelled else []
            held = [np.concatenate(x) for x in zip(held, more)] if held else more
            if len(held[0]) and held[0][0] != held[0][-1]:  # the last cell may go on in the next batch
                to = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
                done, held = [x[:to] for x in held], [x[to:] for x in held]
                yield found(*done[:3], done[3] if labelled else None)
        if held and len(held[0]):
            yield found(*held[:3], held[3] if labelled else None)

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(scan, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have at least the similarity ``least``."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            of = lambda c: [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in part.column(c)]  # noqa: E731, B023
            keep = pa.array([similarity(x, y) >= least for x, y in zip(of("a_set"), of("b_set"))], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    end = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(scan, "a bigint, b bigint")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingles of ``wanted`` (node, row_key), eight bytes each."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [np.unique(shingles(t, words)).tobytes() for t in texts_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, type=pa.binary())], names=["node", "shingles"])

    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    one = keyed.join(wanted, "row_key").select("node", "text").dropDuplicates(["node"])
    return one.mapInArrow(scan, "node bigint, shingles binary")


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, distance: int, least: float) -> DataFrame:
    """(a, b): links of ``nodes`` (node, fp, ..., keys, row_key) of similarity ``least`` or more, enough to connect all such pairs.

    All near pairs of a small cell are verified. Of a large cell first those steps that span it
    are, then the nearest pairs between the components found so far, at last all such pairs.
    """
    names = _names(LONGS)
    keyed = nodes.select("node", *names, F.explode("keys").alias("key"))
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "key-sizes")
    parts = F.when(F.col("n") > CELL, F.ceil(F.col("n") / F.lit(CELL // 2))).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    cell = F.when(parts.isNull(), F.array("key")).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    )
    cells = keyed.join(sizes, "key").select("node", *names, (F.col("n") > PAIRS).alias("large"), F.explode(cell).alias("cell"))
    cells = stored(cells, "cells")
    tested = stored(_pairs(cells.drop("large"), distance), "pairs")
    large = cells.where("large").drop("large")
    again = not large.isEmpty()
    ends = tested.select(F.col("a").alias("node")).union(tested.select("b"))
    wanted = (ends.union(large.select("node")) if again else ends).distinct()
    sets = stored(_shingle_sets(docs, nodes.select("node", "row_key").join(wanted, "node"), words), "shingle-sets")
    links = stored(_verified(tested, sets, least), "similar")
    for most in ROUNDS if again else ():
        labels = components(links)
        labelled = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs = stored(_pairs(labelled, distance, most).join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = links.union(stored(_verified(pairs, sets, least), "similar"))
            tested = tested.union(pairs)
    return links


def without_near_duplicates(docs: DataFrame, words: int = 5, distance: int = 100, least: float = 0.8) -> DataFrame:
    """One row of each component of ``docs``, with the columns of ``docs``.

    Two texts are linked if their sets of ``words``-word shingles have at least the Jaccard
    similarity ``least``, counted exactly. Candidates share a key of ``BANDS`` bands of least
    hashes and differ in at most ``distance`` of 384 bits of six fingerprints of their sets; at
    similarity 0.8 that is 58 bits on average and of sets of four and five shingles 72, with a
    deviation of 7 to 8, so that by calculation one pair in 10,000 of such short texts and fewer
    of others are missed. The row with the smallest id stays. Of rows that repeat it in id and
    text, one stays.
    """
    rows = stored(_set_nodes(docs, words), "shingle-nodes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    whole = F.first(F.struct(*_names(LONGS), "keys")).alias("of")
    nodes = stored(rows.groupBy("node").agg(first, whole).select("node", "first", F.col("first.row_key").alias("row_key"), "of.*"), "distinct-sets")
    labels = components(similar_links(docs, nodes, words, distance, least))
    joined = nodes.join(labels, "node", "left").select("first", F.coalesce("label", "node").alias("label"))
    keep = stored(joined.groupBy("label").agg(F.min("first").alias("lead")).select(F.col("lead.row_key").alias("__kept")), "kept")
    keyed = docs.withColumn("__row_key", row_key(F.col("doc_id"), F.col("text")))
    kept = keyed.join(keep, F.col("__row_key") == F.col("__kept"), "left_semi")
    place = F.row_number().over(W.partitionBy("__row_key").orderBy("__row_key"))
    return kept.withColumn("__place", place).where(F.col("__place") == 1).drop("__row_key", "__place")
