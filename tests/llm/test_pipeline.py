"""The corpus pipeline: whole runs on odd tables, and its stages against plain Python."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from corpuslens.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pii int, __row_key string"


def components_by_hand(rows):
    """Smallest id of each row's group: fingerprints within 4 bits, linked transitively."""
    fps = [simhash.fingerprint((t or "").encode()) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row)
    kept = set()
    for members in groups.values():
        first = min(members, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        kept.add((first[0], first[1]))
    return kept


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(30, 200))) for _ in range(40)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i, text, "en", f"s{i % 3}", len(text), 7, "user"))
        if i % 4 == 0:  # a near copy: one word changed
            words = text.split()
            words[len(words) // 2] = "changed"
            rows.append((1000 + i, " ".join(words), "en", "s9", 0, None, None))
        if i % 5 == 0:  # an exact copy with another id, and a repeated row
            rows.append((2000 + i, text, "de", "s8", 0, 1, "x"))
            rows.append(rows[-1])
    rows += [(3000, None, None, None, None, None, None), (3001, "", "en", "s1", 0, None, None), (None, "no id at all here", None, None, None, None, None)]
    rows.append((3002, "mail me at joe.doe@mail.example.org please " + base[1], "en", "s1", 0, 3, None))
    return rows


def write(folder, rows):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("pii", pa.int32()), ("__row_key", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema), folder / "documents.parquet")
    labels = [{"doc_id": r[0], "quality": 1, "toxic": int(i % 9 == 0)} for i, r in enumerate(rows) if r[0] is not None]
    pq.write_table(pa.Table.from_pylist(labels, schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    items = [{"item_id": 1, "text": " ".join(rows[0][1].split()[:20]) if rows else "x"}, {"item_id": 2, "text": None}]
    pq.write_table(pa.Table.from_pylist(items, schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])), folder / "benchmark.parquet")


def test_near_duplicate_stage_against_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    assert len(out) == len(set(out))
    assert set(out) == components_by_hand(rows)
    assert all(r["__row_key"] in (None, "user", "x") for r in got.collect())


def test_personal_data_keeps_a_column_named_pii(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    out = corpus_pipeline.replace_personal_data(spark, docs, "")
    assert out.columns == docs.columns
    row = out.where("doc_id = 3002").first()
    assert row.pii == 3 and "joe.doe@mail.example.org" not in row.text and "@" in row.text


@pytest.mark.parametrize("empty", [False, True])
def test_whole_run(spark, tmp_path, empty):
    rows = [] if empty else corpus()
    write(tmp_path, rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert packed == []
        return
    ids = {r.doc_id for r in packed}
    # copies left the corpus: of each exact copy group at most one id remains
    for i in range(0, 40, 5):
        assert not ({i, 2000 + i} <= ids)
    assert 0 not in ids  # it holds the benchmark passage
