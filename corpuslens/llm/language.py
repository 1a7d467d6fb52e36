"""Language identification by cross-parsing entropy.

Of each language a suffix automaton of sample text is built. A text is parsed against it from
left to right into the longest phrases that occur in the sample; where the next letter can't
extend a phrase, a new one begins. The language that needs the fewest phrases, normalised by
what naming a place in its sample costs (``log2`` of its length) and by the text's length,
wins: this is the cross-entropy in bits a letter.

Texts are reduced to lower-case letters (bytes A-Z and all beyond ASCII) with single spaces
between them. All stretches of ``STRETCH`` reduced bytes are parsed side by side, one letter
of each at a time, by looking transitions up in a table; a phrase ends at a stretch's end.

The automata learn from a bounded sample: the first ``SAMPLE_CHARS`` characters of
``SAMPLE_TEXTS`` texts of each language, chosen by a hash of the id, and of these as many
bytes as keep the tables within ``TABLE_BYTES``. Prediction parses whole texts.

Result for odd input: a text that is null or has no letter is ``und`` with score 0; so is
every text if no language was learned; rows without language teach nothing; equal costs go to
the language first in alphabet, with score 0; with a single language the score is 1; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import chunks, utf8

SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_BYTES = 60, 2000, 24_000
TABLE_BYTES = 64 << 20
STRETCH = 256
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """By byte: its class, 0 for what is no letter; capitals A-Z count as small letters."""
    table = np.zeros(256, dtype=np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 256)
    return table


def reduced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters with single spaces (0) between words, and where each row begins in them."""
    x = _letters()[data]
    keep = x > 0
    keep[1:] |= x[:-1] > 0  # the first of several separators
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = x[starts] > 0
    total = np.r_[0, np.cumsum(keep)]
    return x[keep], total[offsets]


class Automata(NamedTuple):
    """Tables of all languages: entry ``state + class`` is ``next state << 2 | new phrases``."""

    names: list[str]
    roots: np.ndarray
    bits: np.ndarray  # what a phrase costs
    classes: np.ndarray  # by byte
    table: np.ndarray


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root, every path spells a substring."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        state = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return edges


def build(samples: dict[str, bytes]) -> Automata:
    """Automata of reduced sample texts."""
    names = sorted(samples)
    used = sorted({b for s in samples.values() for b in s} | {0})
    width = len(used) + 1  # one class for bytes that no sample has
    most = TABLE_BYTES // (8 * width * max(1, len(names)))
    classes = np.full(256, len(used), dtype=np.int32)
    classes[used] = np.arange(len(used))
    roots, bits, tables, base = [], [], [], 0
    for name in names:
        text = samples[name][:most]
        edges = suffix_automaton(text)
        own = np.full((len(edges), width), -1, dtype=np.int64)
        for state, out in enumerate(edges):
            for c, to in out.items():
                own[state, classes[c]] = (base + to * width) << 2
        # a letter that the sample lacks is a phrase, and so begins another one behind it
        own[1:] = np.where(own[1:] >= 0, own[1:], np.where(own[0] >= 0, own[0] | 1, (base << 2) | 2))
        own[0] = np.where(own[0] >= 0, own[0], (base << 2) | 1)
        roots.append(base)
        bits.append(np.log2(max(2, len(text))))
        tables.append(own.ravel())
        base += own.size
    table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int64)
    return Automata(names, np.array(roots, dtype=np.int64), np.array(bits), classes, table.astype(np.int32) if base < 1 << 29 else table)


def costs(automata: Automata, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits a letter of each row (axis 1) in each language (axis 0)."""
    sizes = np.diff(bounds)
    per_text = -(-sizes // STRETCH)
    rows = np.repeat(np.arange(len(sizes)), per_text)
    index = np.arange(len(rows)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = bounds[:-1][rows] + index * STRETCH
    size = np.minimum(bounds[1:][rows] - begin, STRETCH)
    order = np.argsort(-size, kind="stable")  # longest first: fewer and fewer go on
    begin, size, rows = begin[order], size[order], rows[order]
    coded = automata.classes[letters]
    state = np.repeat(automata.roots[:, None], len(rows), axis=1)
    phrases = np.ones((len(automata.names), len(rows)), dtype=np.int32)
    for step in range(STRETCH):
        on = int(np.searchsorted(-size, -step))  # sizes above `step`
        if not on:
            break
        seen = automata.table[state[:, :on] + coded[begin[:on] + step]]
        phrases[:, :on] += seen & 3
        state[:, :on] = seen >> 2
    phrases -= state == automata.roots[:, None]  # begun behind an unknown last letter
    out = np.zeros((len(automata.names), len(sizes)))
    for k, bits in enumerate(automata.bits):
        out[k] = np.bincount(rows, weights=phrases[k], minlength=len(sizes)) * bits / np.maximum(sizes, 1)
    return out


def learn(docs: DataFrame, teaches: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Automata:
    """Automata from rows that ``teaches`` selects."""
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    pool = docs.where(teaches & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), F.substring(text, 1, SAMPLE_CHARS).alias("text")
    )
    rows = pool.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS).collect()  # bounded a language
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    samples = {}
    for name, own in texts.items():
        data = np.frombuffer("\n".join(dict.fromkeys(own)).encode(), dtype=np.uint8)
        sample = reduced(data, np.array([0, len(data)]))[0].tobytes()[:SAMPLE_BYTES]
        if sample.strip(b"\0"):
            samples[name] = sample
    return build(samples)


def identified(docs: DataFrame, automata: Automata, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): ``score`` is how much less the best language costs than the next."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)  # at most TABLE_BYTES

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        names = np.array([*automata.names, UNKNOWN], dtype=object)
        for part in parts:
            data, offsets = utf8(part.column("text"))
            lang, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
            for low, high in chunks(offsets):
                raw = data[offsets[low] : offsets[high]]
                letters, bounds = reduced(raw, offsets[low : high + 1] - offsets[low])
                has = np.add.reduceat(np.r_[(letters > 0) & (letters < 0x80), False], np.minimum(bounds[:-1], len(letters))) * (np.diff(bounds) > 0) > 0
                for row in np.flatnonzero(~has & (np.diff(bounds) > 0)):  # no A-Z: other scripts or signs
                    has[row] = any(map(str.isalpha, bytes(data[offsets[low + row] : offsets[low + row + 1]]).decode()))
                if len(automata.names):
                    cost = np.sort(found := costs(automata, letters, bounds), axis=0)
                    lead = 1 - cost[0] / np.maximum(cost[1], 1e-12) if len(cost) > 1 else np.ones(high - low)
                    lang[low:high] = np.where(has, found.argmin(axis=0), len(names) - 1)
                    score[low:high] = np.where(has, np.clip(lead, 0, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[lang], type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[doc_id]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")
