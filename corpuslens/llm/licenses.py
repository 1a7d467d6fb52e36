"""License scan: an exact set-similarity join of license notices with stretches of text.

A *block* is a run of as many words as the template has. It matches if it has at least
``threshold`` of the template's different words. Instead of comparing all blocks:

* the different words of all templates are counted over the whole corpus and put in order of
  frequency; of each template the rarest ``n - ceil(threshold * n) + 1`` words are its prefix,
  and a matching block has one of them (prefix filter);
* a block that holds a prefix word lies within a template's length around it, and the words
  of the template near that place must suffice (positional filter); a text of fewer words
  than needed is left out (length filter);
* the remaining blocks are counted exactly, moving word by word.

Beside the templates, the base phrases are found wherever their words stand consecutively.

Result for odd input: a null or empty text has no words, labels or places, and score 0;
repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import TEXT_WORDS, Words, words_of

# --- Fixed values: phrases and their labels, wording of public license notices ----------
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
}
# --- end of fixed values ---------------------------------------------------------------
THRESHOLD = 0.8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(0x41, 0x5B)}))


def _hashes(words: list[str]) -> np.ndarray:
    """The hash that texts' words have."""
    data = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, data)])
    return Words(np.frombuffer(b"".join(data), dtype=np.uint8), offsets, TEXT_WORDS).hashes


def word_frequencies(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of ``words`` stands in the column ``text``, all rows counted."""
    order = np.argsort(_hashes(words))
    hashes = _hashes(words)[order]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), dtype=np.int64)
        for part in parts:
            for _, _, found in words_of(part.column("text"), TEXT_WORDS):
                at = np.minimum(np.searchsorted(hashes, found.hashes), len(hashes) - 1)
                total += np.bincount(order[at[hashes[at] == found.hashes]], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], names=["word", "n"])

    rows = texts.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {words[r["word"]]: r["n"] for r in rows}  # a row a template word
    return {w: found.get(w, 0) for w in words}


class Template(NamedTuple):
    label: str
    length: int  # words of a block
    needed: int  # different words that a block must have
    vocabulary: frozenset[str]
    prefix: frozenset[str]


def templates_for(frequency: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = []
    for label, text in templates.items():
        words = template_words(text)
        ranked = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        needed = ceil(threshold * len(ranked) - 1e-9)
        out.append(Template(label, len(words), needed, frozenset(ranked), frozenset(ranked[: len(ranked) - needed + 1])))
    return out


def best_block(words: list[str], places: list[int], template: Template) -> int:
    """Most different template words in a block that has one of ``places``; 0 if none has enough."""
    best, side = 0, template.length - 1
    at = 0
    while at < len(places):
        low, high = max(0, places[at] - side), places[at] + side + 1
        at += 1
        while at < len(places) and places[at] - side <= high:
            high = places[at] + side + 1
            at += 1
        stretch = words[low:high]
        if len(template.vocabulary.intersection(stretch)) < template.needed:
            continue
        counts: dict[str, int] = {}
        for k, word in enumerate(stretch):
            if word in template.vocabulary:
                counts[word] = counts.get(word, 0) + 1
            if k >= template.length and (gone := stretch[k - template.length]) in template.vocabulary:
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            best = max(best, len(counts))
    return best if best >= template.needed else 0


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``labels`` are those of phrases and of templates, ``score`` is 1 if a phrase was found,
    else the largest share of a template's words that a matching block has, else 0.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    vocabulary = sorted({w for t in templates.values() for w in template_words(t)})
    found = templates_for(word_frequencies(texts, vocabulary), templates, threshold)
    phrases = [(p.split(" "), label) for p, label in PHRASES.items()]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = {len(p): None for p, _ in phrases}
        wanted = {len(p): [] for p, _ in phrases}
        for p, label in phrases:
            data = " ".join(p).encode()
            _, h = Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), TEXT_WORDS).grams(len(p))
            wanted[len(p)].append((h[0], " ".join(p), label))
        prefix_words = sorted(set().union(*(t.prefix for t in found))) if found else []
        prefix_hashes = np.sort(_hashes(prefix_words)) if prefix_words else np.zeros(1, dtype=np.uint64)
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for low, high, words in words_of(part.column("text"), TEXT_WORDS):
                places: list[list] = [[] for _ in range(high - low)]
                for n in gram:
                    at, h = words.grams(n)
                    for value, phrase, label in wanted[n]:
                        for k in at[h == value]:
                            if words.text(k, k + n) == phrase:
                                places[words.rows[k]].append((k - words.bounds[words.rows[k]], label))
                near = np.minimum(np.searchsorted(prefix_hashes, words.hashes), len(prefix_hashes) - 1)
                candidate = np.unique(words.rows[prefix_hashes[near] == words.hashes]) if prefix_words else []
                matched: dict[int, dict[str, float]] = {}
                for row in candidate:
                    first, last = words.bounds[row], words.bounds[row + 1]
                    if last - first < min(t.needed for t in found):
                        continue
                    own = words.text(first, last).split(" ")
                    for t in found:
                        at = [k for k, w in enumerate(own) if w in t.prefix] if len(own) >= t.needed else []
                        if at and (n := best_block(own, at, t)):
                            matched.setdefault(row, {})[t.label] = n / len(t.vocabulary)
                for row in range(high - low):
                    starts = [k for k, _ in places[row]]
                    base = {label for _, label in places[row]}
                    more = matched.get(row, {})
                    out["n_words"].append(int(words.counts[row]))
                    out["n_base"].append(len(starts))
                    out["first_word"].append(int(min(starts)) if starts else None)
                    out["last_word"].append(int(max(starts)) if starts else None)
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | set(more))))
                    out["score"].append(1.0 if base else max(more.values(), default=0.0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, type=k) for v, k in zip(out.values(), kinds))], names=["doc_id", *out])

    kind = dict(docs.dtypes)[doc_id]
    return texts.mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
