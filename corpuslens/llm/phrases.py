"""Collocations: phrases of two to four words that occur together far more than their parts.

Counting goes by length, in three passes over the texts: words, then pairs, then phrases of three
and four. A phrase occurs no more often than its parts, so a pass lets through only phrases whose
words (then: pairs) may be frequent by a bit table, of bounded size, of the frequent ones of the
pass before. The table may let others through, which their counts drop; it never holds one back.

Each pass counts in a HAT-trie per task: word ids (64-bit hashes of the word bytes) form a shallow
trie on the first word of each phrase, per language; under each trie node lies a hash
container of (phrase, count) that bursts into 64 children by the next bits of the first word
when it grows past ``BURST`` entries. When a task holds more than ``BUDGET`` entries it spills
its largest subtree as a sorted run; at the end all subtrees are spilled. Spark merges the runs
by phrase key (partial sums before the shuffle, final sums after), so no phrase has to fit
into one task beside all others.

Texts: A-Z lower-cased, null is empty, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces
into words ``[^\\x20\\x09]+``; a phrase never spans pieces. Languages: ``lang`` (null: ``und``).

Scores: a phrase with ``a`` occurrences, cut after its first ``k`` words into parts with
``l`` and ``r`` occurrences, scores ``floor(2000000 * a / (l + r))``; its weakest cut counts
(ties to the smallest ``k``). A candidate (``a >= MIN_COUNT``) is dropped where its words lie
contiguously in a longer candidate that occurs at least ``SHARE`` of its own count. The first
``TOP`` per language by score, ``a`` (both descending) and phrase (ascending, UTF-8 bytes)
are returned. Empty tables give no rows; other columns of ``docs`` are ignored.

Word ids are checked: two words of one language that share the id of a frequent word raise an
error, so a collision can never merge two phrases silently.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import Words, _lower_bytes, mixed, stored, utf8
from corpuslens.llm.common import chunks as row_ranges

#: fixed values of the contract
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MIN_COUNT, LONGEST, TOP, SCALE = 30, 4, 2000, 2000000
SHARE = (80, 100)  # a longer candidate absorbs one whose count it reaches 80 in 100 of

#: entries of a container before it bursts, and of a task's trie before it spills (48 bytes each)
BURST = 1 << 14
BUDGET = 1 << 18
#: bytes of text whose phrases are made at once
STRETCH = 1 << 19
PREFIX_BITS = 6
#: The bit table has about 64 bits a frequent phrase and no more than 2^27 bits (16 MB).
BITS_PER_PHRASE, MOST_BITS = 64, 27
#: a language's candidates are ranked in so many parts first, so that no task sorts them all
SPREAD = 64
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
RUN_SCHEMA = pa.schema(
    [("lang", pa.string()), ("n", pa.int8()), *((w, pa.int64()) for w in WORDS), ("count", pa.int64()), ("word", pa.string())]
)


def _word_bytes() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, *PIECE_ENDS]] = False
    return table


def _ends() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(PIECE_ENDS)] = True
    return table


_IS_WORD, _IS_END = _word_bytes(), _ends()


class PieceWords(Words):
    """Words of consecutive rows as ``common.Words``, and whether each word's piece goes on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:  # noqa: D107 - the base class's bounds, by other word bytes
        self.data, self.offsets = _lower_bytes()[data], offsets
        word = _IS_WORD[self.data]
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
        self.hashes = self._hash()
        cut = np.concatenate([[0], np.cumsum(_IS_END[self.data])])
        #: word i and word i + 1 stand in one piece of one row
        self.joined = (self.rows[:-1] == self.rows[1:]) & (cut[self.starts[1:]] == cut[self.ends[:-1]])

    def phrases(self, n: int) -> np.ndarray:
        """First words of the phrases of ``n`` words within pieces."""
        count = max(0, len(self.starts) - n + 1)
        if n == 1 or not count:
            return np.arange(count)
        broken = np.concatenate([[0], np.cumsum(~self.joined)])
        return np.flatnonzero(broken[n - 1 : n - 1 + count] == broken[:count])


class Container:
    """Sorted, summed (lang, n, w1..w4) keys with counts; may burst into children."""

    __slots__ = ("keys", "counts", "pending", "children", "depth")

    def __init__(self, depth: int) -> None:
        self.keys, self.counts, self.pending, self.children, self.depth = None, None, [], None, depth

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if self.children is not None:
            self._deal(keys, counts)
            return
        self.pending.append((keys, counts))
        if sum(len(k) for k, _ in self.pending) > BURST // 4:
            self.compact()

    def compact(self) -> None:
        if not self.pending:
            return
        parts = self.pending + ([(self.keys, self.counts)] if self.keys is not None else [])
        self.keys, self.counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.pending = []
        if len(self.keys) > BURST and self.depth * PREFIX_BITS < 60:
            keys, counts = self.keys, self.counts
            self.keys = self.counts = None
            self.children = {}
            self._deal(keys, counts)

    def _deal(self, keys: np.ndarray, counts: np.ndarray) -> None:
        shift = np.uint64(64 - PREFIX_BITS * (self.depth + 1))
        part = (keys[:, 2].astype(np.uint64) >> shift) & np.uint64((1 << PREFIX_BITS) - 1)
        order = np.argsort(part, kind="stable")
        part, keys, counts = part[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(part)]):
            child = self.children.setdefault(int(part[low]), Container(self.depth + 1))
            child.add(keys[low:high], counts[low:high])

    def settle(self) -> None:
        """Sum what is pending in the whole subtree."""
        for child in [] if self.children is None else self.children.values():
            child.settle()
        self.compact()

    def size(self) -> int:
        if self.children is not None:
            return sum(c.size() for c in self.children.values())
        return sum(len(k) for k, _ in self.pending) + (0 if self.keys is None else len(self.keys))

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the subtree, children in key order."""
        if self.children is not None:
            for part in sorted(self.children):
                yield from self.children[part].runs()
            return
        self.compact()
        if self.keys is not None and len(self.keys):
            yield self.keys, self.counts


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys summed. Keys are ordered by a 64-bit mix of their columns; where two keys
    share a mix they may stay apart, which the merge in Spark, by whole keys, makes good."""
    with np.errstate(over="ignore"):
        mix = keys.view(np.uint64) @ _MIX[: keys.shape[1]] if len(keys) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(mix, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = np.any(keys[1:] != keys[:-1], axis=1)
    starts = np.flatnonzero(new)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def _langs(codes: np.ndarray, names: dict[int, str]) -> pa.Array:
    """Language names of codes, decoded by Arrow."""
    table = pa.array([names[k] for k in range(len(names))], pa.string())
    return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), table).cast(pa.string())


def _spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The words at ``at`` as a string array, gathered without a Python loop."""
    starts, ends = words.starts[at], words.ends[at]
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(int(offsets[-1]), dtype=np.int64)
    data = words.data[index]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


class PhraseTrie:
    """Per task: languages, then the first word's top bits, then bursting containers."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.roots: dict[tuple[int, int], Container] = {}
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(keys, counts)
        top = (keys[:, 2].astype(np.uint64) >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)
        node = keys[:, 0] * (1 << PREFIX_BITS) + top
        order = np.argsort(node, kind="stable")
        node, keys, counts = node[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.diff(node)) + 1
        for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(node)]):
            key = divmod(int(node[low]), 1 << PREFIX_BITS)
            self.roots.setdefault(key, Container(1)).add(keys[low:high], counts[low:high])
        self.held += len(keys)
        if self.held > BUDGET:
            for container in self.roots.values():
                container.settle()
            sizes = {k: c.size() for k, c in self.roots.items()}
            self.held = sum(sizes.values())
            while self.held > BUDGET // 2:
                largest = max(sizes, key=sizes.get)
                yield from self.spill(largest)
                self.held -= sizes.pop(largest)

    def spill(self, key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        names = {v: k for k, v in self.langs.items()}
        for keys, counts in self.roots.pop(key).runs():
            yield _run(keys, counts, names)

    def spill_all(self) -> Iterator[pa.RecordBatch]:
        for key in sorted(self.roots):
            yield from self.spill(key)


def _run(keys: np.ndarray, counts: np.ndarray, names: dict[int, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            _langs(keys[:, 0], names),
            pa.array(keys[:, 1].astype(np.int8)),
            *(pa.array(keys[:, 2 + k]) for k in range(LONGEST)),
            pa.array(counts),
            pa.nulls(len(keys), pa.string()),
        ],
        schema=RUN_SCHEMA,
    )


def _slots(langs: np.ndarray, ids: list[np.ndarray], bits: int) -> np.ndarray:
    """Places in a bit table of phrases, given by their languages' checksums and their word ids."""
    total = langs.astype(np.uint64)
    with np.errstate(over="ignore"):
        for word in ids:
            total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + word.view(np.uint64))
    return (total >> np.uint64(64 - bits)).astype(np.int64)


def _checksum(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _bit_table(phrases: DataFrame, n: int) -> tuple[Broadcast, int]:
    """Bits of the phrases of ``n`` words: 4 KB a row, ``2 ** (bits - 15)`` rows at most."""
    bits = int(np.clip(np.ceil(np.log2(max(1, phrases.count()) * BITS_PER_PHRASE)), 16, MOST_BITS))

    def slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs = np.array([_checksum(x) for x in part.column("lang").to_pylist()], dtype=np.uint64)
            ids = [np.asarray(part.column(w)).astype(np.int64) for w in WORDS[:n]]
            yield pa.RecordBatch.from_arrays([pa.array(_slots(langs, ids, bits))], names=["bit"])

    rows = (
        phrases.select("lang", *WORDS[:n])
        .mapInArrow(slots, "bit bigint")
        .groupBy((F.col("bit") / 32768).cast("bigint").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))
        .collect()
    )
    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in rows:
        table[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(table), bits


def _may_be_frequent(words: PieceWords, n: int, langs: np.ndarray, table: tuple[Broadcast, int]) -> np.ndarray:
    """Whether the phrase of ``n`` words at each place may be in the table; one place more than words."""
    held, bits = table
    at, ids = words.phrases(n), words.hashes.view(np.int64)
    slots = _slots(langs[words.rows[at]], [ids[at + k] for k in range(n)], bits)
    found = np.zeros(len(words.starts) + 1, dtype=bool)
    found[at] = (held.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
    return found


def _count_runs(sizes: tuple[int, ...], tables: dict[int, tuple[Broadcast, int]], names_too: bool) -> Callable:
    """Counting of the phrases of ``sizes`` words that the table of the longest shorter ones lets through.

    Without a table all are counted, and each language's words. ``names_too`` adds the texts of
    the words that the table of words has.
    """
    part = max(tables, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PhraseTrie()
        seen: dict[int, np.ndarray] = {}  # word ids whose text is out, sorted, per language
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, offsets = utf8(batch.column("text"))
            for low, high in row_ranges(offsets, STRETCH):
                base = offsets[low]
                words = PieceWords(data[base : offsets[high]], offsets[low : high + 1] - base)
                of_rows = [x or "und" for x in langs[low:high]]
                code = np.array([trie.langs.setdefault(x, len(trie.langs)) for x in of_rows], dtype=np.int64)
                checksums = np.array([_checksum(x) for x in of_rows], dtype=np.uint64)
                ids = words.hashes.view(np.int64)
                usable = {n: _may_be_frequent(words, n, checksums, table) for n, table in tables.items()}
                parts = []
                for n in sizes:
                    at = words.phrases(n)
                    if part:
                        let_through = np.ones(len(at), dtype=bool)
                        for k in range(n - part + 1):
                            let_through &= usable[part][at + k]
                        at = at[let_through]
                    key = np.zeros((len(at), 2 + LONGEST), dtype=np.int64)
                    key[:, 0] = code[words.rows[at]] if len(at) else 0
                    key[:, 1] = n
                    for k in range(n):
                        key[:, 2 + k] = ids[at + k]
                    parts.append(key)
                keys = np.concatenate(parts)
                if len(keys):
                    yield from trie.add(keys, np.ones(len(keys), dtype=np.int64))
                names = {v: k for k, v in trie.langs.items()}
                if not part:
                    # words of each language, as phrase length -1
                    totals = np.bincount(code[words.rows], minlength=len(trie.langs)) if len(words.rows) else np.zeros(0, dtype=np.int64)
                    used = np.flatnonzero(totals)
                    if len(used):
                        yield _rows(used, -1, np.zeros(len(used), dtype=np.int64), totals[used], pa.nulls(len(used), pa.string()), names)
                if names_too:
                    # the text of each word id, once a task and language
                    new_at = []
                    wanted = np.flatnonzero(usable[1][: len(ids)])
                    row_code = code[words.rows] if len(ids) else ids
                    for c in np.unique(row_code[wanted]).tolist():
                        mine = wanted[row_code[wanted] == c]
                        fresh, first = np.unique(ids[mine], return_index=True)
                        old = seen.get(c, np.zeros(0, dtype=np.int64))
                        unseen = ~np.isin(fresh, old, assume_unique=True)
                        seen[c] = np.union1d(old, fresh[unseen])
                        new_at.append(mine[first[unseen]])
                    new = np.concatenate(new_at) if new_at else np.zeros(0, dtype=np.int64)
                    if len(new):
                        yield _rows(row_code[new], 0, ids[new], np.zeros(len(new), dtype=np.int64), _spelled(words, new), names)
        yield from trie.spill_all()

    return run


def _rows(codes: np.ndarray, n: int, ids: np.ndarray, counts: np.ndarray, words: pa.Array, names: dict[int, str]) -> pa.RecordBatch:
    """Rows that are no phrases: of length ``n``, with one id, a count and a text each."""
    zeros = pa.array(np.zeros(len(codes), dtype=np.int64))
    return pa.RecordBatch.from_arrays(
        [_langs(codes, names), pa.array(np.full(len(codes), n, dtype=np.int8)), pa.array(ids), *([zeros] * (LONGEST - 1)),
         pa.array(counts.astype(np.int64)), words],
        schema=RUN_SCHEMA,
    )


def _pass(rows: DataFrame, sizes: tuple[int, ...], tables: dict[int, tuple[Broadcast, int]], names_too: bool = False) -> DataFrame:
    """One pass over the texts: the summed runs of all tasks."""
    runs = rows.mapInArrow(_count_runs(sizes, tables, names_too), "lang string, n byte, w1 long, w2 long, w3 long, w4 long, count long, word string")
    used, total = max(sizes), F.sum("count").alias("f")
    grouped = runs.groupBy("lang", "n", *WORDS[:used])  # words beyond the longest phrase are zero
    if not names_too:
        rest = [F.lit(0).cast("long").alias(w) for w in WORDS[used:]]
        return grouped.agg(total).select("lang", "n", *WORDS[:used], *rest, "f", F.lit(None).cast("string").alias("word"))
    merged = grouped.agg(total, F.min("word").alias("word"), F.max("word").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two words share an id: "), F.col("word"), F.lit(" / "), F.col("other")))
    return merged.select("lang", "n", *WORDS, "f", F.when(F.col("word") == F.col("other"), F.col("word")).when(F.col("n") == 0, clash).alias("word"))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT) -> DataFrame:
    """Occurrences of every phrase of one to four words that has ``least``, per language, and words' texts.

    Rows with ``n`` 0 name the id of a frequent word: ``w1`` and its text ``word``; rows with ``n`` -1 hold
    a language's number of words in ``f``; the others count phrases. Each pass is written
    once: what later steps read of the counts.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    kept = (F.col("n") <= 0) | (F.col("f") >= least)
    words = stored(_pass(rows, (1,), {}).where(kept), "phrase-words")
    tables = {1: _bit_table(words.where("n = 1"), 1)}
    pairs = stored(_pass(rows, (2,), tables).where(kept), "phrase-pairs")
    tables = {**tables, 2: _bit_table(pairs, 2)}
    longer = stored(_pass(rows, tuple(range(3, LONGEST + 1)), tables, names_too=True).where(kept), "phrase-counts")
    return words.unionByName(pairs).unionByName(longer)


def _key(n: Column, words: list[Column]) -> list[Column]:
    """A phrase's key columns; words beyond ``n`` are zero."""
    return [n.cast("byte").alias("n"), *(F.when(n > k, w).otherwise(F.lit(0)).cast("long").alias(f"w{k + 1}") for k, w in enumerate(words))]


def _first_of(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each language: first within ``SPREAD`` parts of it, then of those."""
    part = F.pmod(F.xxhash64(*WORDS), F.lit(SPREAD))
    some = rows.select("*", part.alias("__part"))
    some = some.select("*", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order)).alias("__at")).where(F.col("__at") <= top)
    return some.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("rank")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = MIN_COUNT) -> DataFrame:
    """The first ``top`` collocations per language: lang, rank, phrase, a, l, r, n, score."""
    counts = counted(docs, text, lang, least)
    totals = counts.where(F.col("n") == -1).select("lang", F.col("f").alias("total"))
    frequent = counts.where((F.col("n") >= 1) & (F.col("f") >= least)).select("lang", "n", *WORDS, "f")
    names = counts.where(F.col("n") == 0).select("lang", F.col("w1").alias("id"), "word")
    candidates = frequent.where(F.col("n") >= 2).select("lang", "n", *WORDS, F.col("f").alias("a"))
    words = [F.col(w) for w in WORDS]

    # every cut of every candidate, with the counts of both parts
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    left = [F.when(F.col("k") > j, words[j]) for j in range(LONGEST)]
    right = [F.try_element_at(F.array(*words), F.col("k") + 1 + j) for j in range(LONGEST)]
    cuts = cuts.select(
        "lang", "n", *WORDS, "a", "k",
        F.struct(*_key(F.col("k"), left)).alias("lk"),
        F.struct(*_key(F.col("n") - F.col("k"), right)).alias("rk"),
    )
    lp = frequent.select(F.col("lang").alias("lang"), F.struct("n", *WORDS).alias("lk"), F.col("f").alias("l"))
    rp = frequent.select(F.col("lang").alias("lang"), F.struct("n", *WORDS).alias("rk"), F.col("f").alias("r"))
    cuts = cuts.join(lp, ["lang", "lk"]).join(rp, ["lang", "rk"])
    score = F.expr(f"cast({SCALE} as decimal(8, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(21, 0))")
    weakest = F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "n", *WORDS, "a").agg(weakest.alias("m")).select("lang", "n", *WORDS, "a", "m.*")

    # candidates inside longer ones that reach SHARE of their count
    inner = [
        F.struct(*_key(F.lit(m), [F.col(WORDS[s + j]) if s + j < LONGEST else F.lit(0) for j in range(LONGEST)]), F.lit(s).alias("s"))
        for m in range(2, LONGEST)
        for s in range(LONGEST - 1)
    ]
    longer = candidates.select("lang", "n", "a", F.explode(F.array(*inner)).alias("in"))
    longer = longer.where((F.col("in.n") < F.col("n")) & (F.col("in.s") + F.col("in.n") <= F.col("n")))
    absorbing = longer.groupBy("lang", F.col("in.n").alias("n"), *(F.col(f"in.{w}").alias(w) for w in WORDS)).agg(F.max("a").alias("most"))
    kept = scored.join(absorbing, ["lang", "n", *WORDS], "left").where(
        F.col("most").isNull() | (F.col("most") * SHARE[1] < F.col("a") * SHARE[0])
    )

    # texts of the kept candidates' words, then the first ``top`` of each language
    place = kept.select("*", F.posexplode(F.slice(F.array(*words), 1, F.col("n"))).alias("at", "id"))
    spelled = place.join(names, ["lang", "id"]).groupBy("lang", "n", *WORDS, "a", "score", "l", "r").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    ranked = _first_of(spelled, top, F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("a").cast("long").alias("a"),
        F.col("l").cast("long").alias("l"),
        F.col("r").cast("long").alias("r"),
        F.col("total").cast("long").alias("n"),
        F.col("score").cast("long").alias("score"),
    )
