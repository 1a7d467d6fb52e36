"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Every rule says from a text's words and counts whether the text is rejected. On a sample of
``SAMPLE`` rows each rule is run alone: its time per text and the share it rejects are
measured, and rules are put in the order of rejections per second. Over all rows a text is
judged rule by rule until one rejects it. The order changes the work, never the verdict: a
text is kept if no rule rejects it.

Result for odd input: a null or empty text has no words, fails the base rule and is not kept;
repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import SPACE_WORDS, Words, chunks, per_row, utf8

#: About so many rows are sampled to order the rules.
SAMPLE = 1000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"


class Facts(NamedTuple):
    """What the base counts say of one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


Rule = Callable[[bytes, Facts], bool]

# --- the rules: True rejects -----------------------------------------------------------


def symbols(text: bytes, facts: Facts) -> bool:
    """More than one symbol in ten words."""
    return 10 * facts.n_symbols > facts.n_words


def word_length(text: bytes, facts: Facts) -> bool:
    """Words of less than 2 or more than 12 characters on average."""
    return not 2 * facts.n_words <= facts.word_chars <= 12 * facts.n_words


def repeated_lines(text: bytes, facts: Facts) -> bool:
    """More than 3 in 10 lines with words repeat an earlier one."""
    return facts.n_dup_lines > 0 and 10 * facts.n_dup_lines > 3 * sum(1 for x in text.split(b"\n") if x.strip())


def shouting(text: bytes, facts: Facts) -> bool:
    """More than 3 in 10 words have capitals A-Z, two at least, and no small letters a-z."""
    words = text.split()
    return 10 * sum(1 for w in words if len(w) > 1 and w.isupper() and sum(0x41 <= b <= 0x5A for b in w) > 1) > 3 * len(words)


def lettered(text: bytes, facts: Facts) -> bool:
    """Fewer than 7 in 10 words have a letter A-Z, a-z or a character beyond ASCII."""
    words = text.split()
    return 10 * sum(1 for w in words if w.isalpha() or any(b > 0x7F or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in w)) < 7 * len(words)


def one_word(text: bytes, facts: Facts) -> bool:
    """One word, as written, makes up more than 3 in 10."""
    words = text.split()
    return bool(words) and 10 * max(Counter(words).values()) > 3 * len(words)


RULES: dict[str, Rule] = {r.__name__: r for r in (symbols, word_length, repeated_lines, shouting, lettered, one_word)}


# --- base counts -----------------------------------------------------------------------


def _is_continuation(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) == 0x80


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    return dup


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each row in windows that the row has twice; windows of equal hash are compared."""
    at, h = words.grams(WINDOW)
    covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if len(at):
        rows = words.rows[at].astype(np.uint64)
        with np.errstate(over="ignore"):
            key = h + rows * np.uint64(0xA24BAED4963EE407)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        # chance meetings of different windows: neighbours in order must have equal words
        pairs = np.flatnonzero(same)
        a, b = at[order[pairs]], at[order[pairs + 1]]
        equal = words.rows[a] == words.rows[b]
        for k in range(WINDOW):
            equal &= words.hashes[a + k] == words.hashes[b + k]
        if not equal.all():
            twice[:] = False
            twice[order[pairs[equal]]] = True
            twice[order[pairs[equal] + 1]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    return per_row(np.cumsum(covered)[:-1] > 0, words.bounds)


def base_counts(column: pa.Array) -> np.ndarray:
    """Rows of ``Facts`` for a text column."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(Facts._fields)), dtype=np.int64)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    for low, high in chunks(offsets):
        base = offsets[low]
        raw, ends = data[base : offsets[high]], offsets[low : high + 1] - base
        words = Words(raw, ends, SPACE_WORDS)
        out[low:high, 0] = words.counts
        letters = np.r_[0, np.cumsum(~_is_continuation(raw))]
        out[low:high, 1] = per_row(letters[words.ends] - letters[words.starts], words.bounds)
        out[low:high, 2] = per_row(symbol[raw], ends)
        out[low:high, 4] = _repeat_words(words)
        whole = raw.tobytes()
        out[low:high, 3] = [_dup_lines(whole[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return out


def base_failed(facts: np.ndarray) -> np.ndarray:
    """Fewer than 20 words, or more than 3 in 10 words in repeated windows."""
    return (facts[:, 0] < 20) | (100 * facts[:, 4] > 30 * facts[:, 0])


# --- the cascade -----------------------------------------------------------------------


def rule_costs(docs: DataFrame, rules: dict[str, Rule], sample: int = SAMPLE) -> DataFrame:
    """(rule, seconds, rejected, n): cost and selectivity of each rule alone, on about ``sample`` rows."""
    share = min(1.0, sample / max(1, docs.count()))

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            facts = base_counts(part.column("text"))
            rows = [(text.as_py().encode(), Facts(*f)) for text, f, bad in zip(part.column("text").fill_null(""), facts.tolist(), base_failed(facts)) if not bad]
            seconds, rejected = [], []
            for rule in rules.values():
                began = time.perf_counter()
                rejected.append(sum(rule(*row) for row in rows))
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(seconds), pa.array(rejected), pa.array([len(rows)] * len(rules))], names=["rule", "seconds", "rejected", "n"])

    found = docs.sample(fraction=share, seed=3).select(F.col("text").cast("string").alias("text")).mapInArrow(measure, "rule string, seconds double, rejected bigint, n bigint")
    return found.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "n")))


def rule_order(costs: list, rules: dict[str, Rule]) -> list[str]:
    """Rules by falling rejections per second; unmeasured ones come last, as listed."""
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in costs}
    return sorted(rules, key=lambda name: -rate.get(name, -1.0))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, rejected_by): the verdict on each row."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = rule_order(rule_costs(texts, rules).collect(), rules)  # a row a rule

    def cascade(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            facts = base_counts(part.column("text"))
            failed = base_failed(facts)
            by: list[str | None] = []
            data, offsets = utf8(part.column("text"))
            raw = memoryview(data)
            for f, bad, low, high in zip(facts.tolist(), failed.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                text, row = bytes(raw[low:high]), Facts(*f)
                by.append("base" if bad else next((name for name in order if rules[name](text, row)), None))
            by = pa.array(by, type=pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(facts[:, k]) for k in range(5)), pa.array(failed), by.is_null(), by],
                names=["doc_id", *Facts._fields, "base_failed", "kept", "rejected_by"],
            )

    kind = dict(docs.dtypes)[doc_id]
    counts = ", ".join(f"{name} bigint" for name in Facts._fields)
    return texts.mapInArrow(cascade, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, rejected_by string")
