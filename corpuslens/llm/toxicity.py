"""Toxicity by a learned lexicon, matched with misspellings and judged in context.

*Lexicon.* From a bounded sample of labelled rows, words that stand in far more different
contexts (neighbouring words) of toxic texts than of others. Copies of a text share their
contexts, so a word does not become a term because a text is repeated.

*Matching.* The terms form a trie. Its product with Levenshtein automata is walked by each
different word of a text: a state is a set of (trie node, edits so far), transitions are made
once and remembered, and most words reach the dead state in a few letters. Terms of five
letters may have one edit, of eight two; digits that look like letters cost nothing.

*Context.* Each match counts by how reliable its term is in the sample, spelled right or
wrong. Matches between quotation marks, or with a word of reporting within ``WINDOW`` words,
count less; those with a word of address count more. The text's score is the chance that at
least one match is meant; where no term is spelled right, that of the clearest misspelling.

Result for odd input: a null or empty text, like any without match, has the score ``CLEAN``;
rows whose label is missing teach nothing; a document that is labelled twice counts once, as
toxic if one of its labels says so; without labels there is no lexicon and all scores are
``CLEAN``; repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import TEXT_WORDS, stored, texts_of, words_of

#: Labelled rows that are learned from, of each label.
SAMPLE = 4000
#: A term has at least so many different toxic contexts, and is so much more frequent there.
LEAST_CONTEXTS, LEAST_SHARE, LEAST_RATIO = 5, 0.01, 12
#: Chance that any word at all becomes a term without being related to the labels.
CHANCE = 0.01
WINDOW = 6
CLEAN = 0.02
KNOWN_WORDS = 200_000
#: Digits read as letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes according reported reads titled word term".split())
ADDRESS = frozenset("you your youre yourself u ur".split())
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """A trie of terms intersected with Levenshtein automata, its states made as they are met."""

    DEAD = 0

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.slack = [0]  # most edits that any term below allows
        for term in terms:
            node = 0
            self.slack[0] = max(self.slack[0], edits_allowed(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], edits_allowed(term))
            self.term[node] = term
        self.clear()

    def clear(self) -> None:
        self.states: list[dict[int, int]] = [{}]
        self.numbers: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._number({0: 0})

    def _number(self, reached: dict[int, int]) -> int:
        """The state of these nodes, with those that skipping letters of terms leads to."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = reached[node] + 1
                if edits <= self.slack[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    todo.append(child)
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(reached)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.slack[node] and edits < reached.get(node, 99):
                reached[node] = edits

        alike = LOOKALIKES.get(letter)
        for node, edits in self.states[state].items():
            reach(node, edits + 1)  # a letter too many
            for c, child in self.children[node].items():
                reach(child, edits if c == letter or c == alike else edits + 1)
        return self._number(reached)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and how many it took."""
        if len(self.steps) > KNOWN_WORDS:
            self.clear()
        state = self.start
        for letter in word:
            step = self.steps.get((state, letter))
            if step is None:
                step = self.steps[(state, letter)] = self._step(state, letter)
            state = step
            if state == self.DEAD:
                return None
        ends = [(edits, self.term[n]) for n, edits in self.states[state].items() if self.term[n] and edits <= edits_allowed(self.term[n])]
        return min(ends)[::-1] if ends else None


class Model(NamedTuple):
    #: by term: how sure a toxic meaning is if it is spelled right, and if not
    terms: dict[str, tuple[float, float]]


class Reader:
    """Finds matches in texts; words met before are not matched again."""

    def __init__(self, terms: list[str]) -> None:
        self.automaton = Automaton(terms)
        self.harmless: set[bytes] = set()
        self.found: dict[bytes, tuple[str, int]] = {}

    def matches(self, text: bytes) -> list[tuple[bytes, str, int]]:
        """(word, term, edits) for the different words of a text that match."""
        own = set(text.translate(_KEEP).split())
        for word in own - self.harmless:
            if word not in self.found:
                hit = self.automaton.match(word.decode())
                if hit:
                    self.found[word] = hit
                else:
                    self.harmless.add(word)
        if len(self.harmless) > KNOWN_WORDS:
            self.harmless.clear()
        return [(w, *self.found[w]) for w in own & self.found.keys()] if self.found else []


def contexts(text: str, words: set[str]) -> Iterator[tuple[str, bool, bool, bool]]:
    """(word, quoted, reported, addressed) for each place of ``words`` in a text."""
    spans = [(m[0].translate(_LOWER), m.start(), m.end()) for m in _WORD.finditer(text)]
    for k, (word, low, high) in enumerate(spans):
        if word in words:
            around = {w for w, _, _ in spans[max(0, k - WINDOW) : k + WINDOW + 1]}
            line = text.rfind("\n", 0, low) + 1
            end = text.find("\n", high)
            left, right = text[line:low], text[high : end if end >= 0 else None]
            marks = left.count('"') % 2 == 1 and '"' in right or left.rfind("“") > left.rfind("”") and "”" in right or left.rfind("«") > left.rfind("»") and "»" in right
            yield word, marks, bool(around & REPORTING), bool(around & ADDRESS)


def score(model: Model, reader: Reader, text: bytes) -> float:
    hits = reader.matches(text)
    if not hits:
        return CLEAN
    by = {word.decode(): (term, edits) for word, term, edits in hits}
    right = any(edits == 0 for _, edits in by.values())
    if right:  # a misspelling adds nothing to a term spelled right
        by = {w: hit for w, hit in by.items() if hit[1] == 0}
    miss = least = 0.0
    for word, quoted, reported, addressed in contexts(text.decode(), by.keys()):
        term, edits = by[word]
        sure = model.terms[term][edits > 0]
        sure *= (0.4 if quoted else 1.0) * (0.6 if reported else 1.0)
        if addressed:
            sure = 1 - (1 - sure) * 0.8
        one = math.log1p(-min(sure, 0.999))
        miss, least = miss + one, min(least, one)
    if not right:  # any number of doubtful spellings is no better than the clearest
        miss = least
    return 1 - (1 - CLEAN) * math.exp(max(miss, -30.0))


# --- learning --------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, teaches: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` different documents a label, chosen by a hash of the id."""
    known = labels.where(teaches & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    first = lambda label: there.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(0).unionByName(first(1))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows


def _neighbours(rows: DataFrame) -> DataFrame:
    """(word, toxic, context): the first place of each word in each text, with a hash of its neighbours."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            toxic = np.asarray(part.column("toxic"))
            for low, _, words in words_of(part.column("text"), TEXT_WORDS):
                n = len(words.starts)
                h = np.r_[np.uint64(0), words.hashes, np.uint64(0)]
                with np.errstate(over="ignore"):
                    around = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[2:]
                    first = np.unique(words.hashes * np.uint64(3) + words.rows.astype(np.uint64), return_index=True)[1]
                length = words.ends - words.starts
                first = first[(length[first] >= 3) & (length[first] <= 40)]
                own = [words.text(k, k + 1) for k in first] if n else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, type=pa.string()), pa.array(toxic[low + words.rows[first]].astype(np.int32)), pa.array(around[first].view(np.int64))], names=["word", "toxic", "context"]
                )

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(scan, "word string, toxic int, context bigint")


def association(t: Column, c: Column, share: float) -> Column:
    """Log-likelihood ratio of ``t`` toxic and ``c`` other places against ``share`` toxic ones."""
    part = lambda n, of: F.when(n > 0, n * F.ln(n / ((t + c) * F.lit(of)))).otherwise(0.0)
    return 2 * (part(t, share) + part(c, 1 - share))


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, sample: int = SAMPLE) -> Model:
    """A lexicon and how sure its terms are; ``teaches`` selects rows of ``labels``."""
    rows = stored(labelled_sample(docs, labels, teaches, sample), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model({})
    seen = lambda label: F.countDistinct(F.when(F.col("toxic") == label, F.col("context")))
    counts = _neighbours(rows).groupBy("word").agg(seen(1).alias("t"), seen(0).alias("c"))
    ratio = (F.col("t") / F.lit(toxic)) / ((F.col("c") + 0.5) / F.lit(clean))
    least = max(LEAST_CONTEXTS, math.ceil(LEAST_SHARE * toxic))
    frequent = stored(counts.where(F.col("t") >= least), "frequent-words")
    strict = NormalDist().inv_cdf(1 - CHANCE / (2 * max(1, frequent.count()))) ** 2
    likely = frequent.where((ratio >= LEAST_RATIO) & (association(F.col("t"), F.col("c"), toxic / (toxic + clean)) >= strict))
    terms = sorted(r["word"] for r in likely.select("word").collect())  # bounded by the sample
    if not terms:
        return Model({})
    return Model(_sureness(rows, terms, toxic, clean))


def _sureness(rows: DataFrame, terms: list[str], toxic: int, clean: int) -> dict[str, tuple[float, float]]:
    """Share of toxic texts among those in which a term matches.

    Misspellings are judged by the texts that have no term spelled right.
    """

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for part in parts:
            found = []
            for text, label in zip(texts_of(part.column("text")), part.column("toxic").to_pylist()):
                hits = reader.matches(text)
                right = any(edits == 0 for _, _, edits in hits)
                found += sorted({(term, edits > 0, label) for _, term, edits in hits if not (right and edits)})
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int32()))], names=["term", "misspelled", "toxic"])

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(scan, "term string, misspelled boolean, toxic int")
    counts = {(r["term"], r["misspelled"], r["toxic"]): r["n"] for r in found.groupBy("term", "misspelled", "toxic").agg(F.count("*").alias("n")).collect()}

    def sure(term: str, misspelled: bool, prior: float, weight: float) -> float:
        t, c = counts.get((term, misspelled, 1), 0), counts.get((term, misspelled, 0), 0)
        return (t + prior * weight) / (t + c + weight)

    return {term: (sure(term, False, 0.9, 2), sure(term, True, 0.7, 2)) for term in terms}


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the score of each row's whole text."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(list(model.terms))
        for part in parts:
            values = np.fromiter((score(model, reader, t) for t in texts_of(part.column("text"))), dtype=float, count=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[doc_id]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(scan, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without rows whose text scores ``limit`` or more, with their columns."""

    @F.arrow_udf("double")
    def value(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(list(model.terms))
        for part in parts:
            yield pa.array([score(model, reader, t) for t in texts_of(part)], type=pa.float64())

    return docs.where(value(F.col("text").cast("string")) < limit)
