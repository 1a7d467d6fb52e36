"""op13: exact duplicates against plain Python; chunk hashes against whole-text hashes."""

import hashlib
import re

import numpy as np

from corpuslens.llm import exact_dedup

SCHEMA = "doc_id long, text string, __idk string, __sha int, kept string"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()


def brute(rows):
    by = {}
    for doc_id, text, *_ in rows:
        by.setdefault(normal(text), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = by[normal(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), hashlib.sha256(normal(text)).hexdigest()))
    return sorted(out, key=repr)


def test_chunk_hashes_combine_to_the_whole():
    text = bytes(range(256)) * 700 + "é ü".encode()
    pieces = [text[i : i + exact_dedup.CHUNK_BYTES] for i in range(0, len(text), exact_dedup.CHUNK_BYTES)]
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, pieces)])
    for k in range(2):
        parts = exact_dedup.shift(exact_dedup.chunk_hashes(data, offsets, k), np.arange(len(pieces)), k)
        assert int(parts.sum()) % exact_dedup.PRIMES[k] == exact_dedup.fingerprint(text, k)


def test_equal_texts_against_plain_python(spark):
    long_text = "word " * 40000  # several chunks
    rows = [
        (1, "a  b\tc", "x", 1, "y"),
        (2, "a b c", None, 2, None),
        (3, "a b c ", None, 3, None),
        (4, None, None, 4, None),
        (5, "", None, 5, None),
        (6, " \n ", None, 6, None),
        (None, "a b c", None, 7, None),
        (None, "only nulls", None, 8, None),
        (None, "only nulls", None, 9, None),
        (7, long_text, None, 10, None),
        (8, long_text.replace("word", "w0rd", 1), None, 11, None),
        (9, long_text + "\n", None, 12, None),
        (10, long_text[:-1] + "x", None, 13, None),
        (11, "repeated", None, 14, None),
        (11, "repeated", None, 15, None),
        (11, "repeated but other", None, 16, None),
    ]
    out = exact_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr) == brute(rows)
    kept = [(r.doc_id, r.text_sha256) for r in out if r.kept]
    assert len(kept) == len({normal(t) for _, t, *_ in rows})
    assert (11, hashlib.sha256(b"repeated").hexdigest()) in kept
    assert (None, hashlib.sha256(b"only nulls").hexdigest()) in kept


def test_empty_table(spark):
    assert exact_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
