"""op12: hard negatives against an exhaustive search in plain Python."""

import math
import random

import pytest

from corpuslens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, score double"


def brute(rows):
    valid = {}
    for vec_id, emb, label, *_ in rows:
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        valid[(vec_id, label, tuple(emb))] = None
    table = []
    for vec_id, label, emb in valid:
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        table.append((vec_id, label, [math.floor(256 * float(x)) for x in emb]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda s, v: (-s, v is None, v if v is not None else 0)
    out = []
    for i, (aid, al, av) in enumerate(table):
        if aid is None or aid % 100:
            continue
        scored = [(dot(av, v), vid, lab, j) for j, (vid, lab, v) in enumerate(table) if j != i]
        pos = sorted((x for x in scored if x[2] == al), key=lambda x: key(x[0], x[1]))[:5]
        for ps, pid, _, _ in pos:
            neg = sorted((x for x in scored if x[2] != al and 30 * ps <= 100 * x[0] <= 90 * ps), key=lambda x: key(x[0], x[1]))[:10]
            out += [(aid, pid, r + 1, nid, ps, ns) for r, (ns, nid, _, _) in enumerate(neg)]
    return sorted(out, key=repr)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "SEED", 6)


def test_against_exhaustive_search(spark, small):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        emb = [rnd.uniform(-0.6, 0.6) for _ in range(8)]
        if i % 50 == 3:
            emb = [0.25] * 8  # a common vector: ties
        rows.append((i, emb, rnd.randrange(4), "x", 1.0))
    rows += [rows[100], rows[200], (1000, None, 1, None, None), (1100, [0.1] * 7 + [None], 1, None, None), (1200, [float("nan")] * 8, 2, None, None)]
    rows += [(1300, [0.1] * 8, None, None, None), (None, [0.3] * 8, 1, None, None), (1400, [0.5, -0.5], 3, None, None), (1500, [0.0] * 8, 0, None, None)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) > 100
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_coordinate_ranges_keep_every_row_above_the_threshold():
    import numpy as np

    rnd = np.random.default_rng(3)
    for trial in range(200):
        width = int(rnd.integers(1, 9))
        vecs = rnd.integers(-150, 150, size=(300, width))
        if trial % 3 == 0:
            vecs[:, 0] = np.abs(vecs[:, 0]) + 200  # coordinates whose own axis lies in the cap
        norms = np.sqrt((vecs.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        bucket = negatives.Bucket(list(range(300)), list(range(300)), [0] * 300, norms[order].tolist(), vecs[order].tolist(), width)
        q = rnd.integers(-150, 150, size=width)
        if trial % 3 == 0:
            q[0] = 250
        scores = bucket.vecs @ q
        for least in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            if least <= 0:
                continue
            found = bucket.candidates(q, float(np.sqrt((q.astype(float) ** 2).sum())), float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())


def test_ranges_and_broadcasts_do_not_grow_with_the_buckets(spark, small, monkeypatch):
    ranges, frame = [], type(spark.range(1))
    was = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *c: (ranges.append((self.columns, n)), was(self, n, *c))[1])
    monkeypatch.setattr(negatives, "BUCKET", 4)
    monkeypatch.setattr(negatives, "FEW", 5, raising=False)
    rnd = random.Random(11)
    rows = [(i, [rnd.uniform(-0.6, 0.6) for _ in range(4)], rnd.randrange(3), "x", 1.0) for i in range(400)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    # Spark samples keys of every range for the driver: 100 buckets need no more than five ranges
    assert [n for columns, n in ranges if "norm" in columns] == [5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def block_of(np, rids, vecs, labels, positives=None):
    n = len(rids)
    wide = lambda k: np.array([[k(x) for x in (positives[i] if positives else [])] + [negatives.LAST] * (5 - len(positives[i] if positives else [])) for i in range(n)], dtype=np.int64)
    of = lambda x: np.asarray(x, dtype=np.int64).tobytes()
    norms = np.sqrt((vecs.astype(float) ** 2).sum(axis=1))
    row = {"a_rids": of(rids), "a_vec_ids": of(rids), "a_labels": of(labels), "a_norms": norms.tobytes(), "a_bytes": 8, "a_vecs": of(vecs)}
    row |= {"p_rids": of(wide(lambda x: x[1])), "p_ids": of(wide(lambda x: x[1])), "p_nulls": np.zeros((n, 5), dtype=bool).tobytes(), "p_scores": of(wide(lambda x: x[0]))}
    return negatives.Block(row, 2 if positives else 1)


@pytest.mark.parametrize("scale, narrow", [(100, 1 / 8), (100, 0.0), (100, 2.0), (3000, 1 / 8), (60_000_000, 1 / 8)])
def test_block_finds_the_first_rows_by_scan_and_by_ranges(monkeypatch, scale, narrow):
    """Copies, ties, null ids, shorter vectors; sums in single and double precision and in integers."""
    import numpy as np

    monkeypatch.setattr(negatives, "NARROW", narrow)
    monkeypatch.setattr(negatives, "SEED", 4)
    monkeypatch.setattr(negatives, "TILE", 7)
    monkeypatch.setattr(negatives, "PAIRS", 50)
    rnd = np.random.default_rng(scale)
    n, width = 600, 6
    vecs = rnd.integers(-scale, scale, size=(n, width))
    vecs[100:300] = vecs[rnd.integers(0, 10, 200)] + rnd.integers(-1, 2, size=(200, width))  # near copies
    vecs[300:340] = vecs[0]  # copies: ties
    vecs[400:500, 4:] = 0
    vecs[500:505] = 0
    labels, ids = rnd.integers(0, 3, n), rnd.permutation(n)
    null = rnd.random(n) < 0.1
    order = np.argsort(-np.sqrt((vecs.astype(float) ** 2).sum(axis=1)), kind="stable")
    norms = np.sqrt((vecs.astype(float) ** 2).sum(axis=1))
    buckets = []
    for a in range(0, n, 90):
        own = order[a : a + 90]
        short = 4 if not vecs[own][:, 4:].any() else width
        buckets.append(negatives.Bucket(own.tolist(), [None if null[i] else int(ids[i]) for i in own], labels[own].tolist(), norms[own].tolist(), vecs[own][:, :short].tolist(), short))
    anchors = np.r_[0:20, 300:310, 400:410, 500:503]
    dot = [[sum(int(x) * int(y) for x, y in zip(vecs[i], v)) for v in vecs] for i in anchors]
    key = lambda i, j: (-dot[i][j], bool(null[j]), 0 if null[j] else int(ids[j]), int(j))

    first = block_of(np, anchors, vecs[anchors], labels[anchors])
    for b in buckets:
        first.meet(b)
    best = [sorted((j for j in range(n) if labels[j] == labels[a] and j != a), key=lambda j: key(i, j))[:5] for i, a in enumerate(anchors)]
    assert first.best.fields[3].tolist() == best
    assert first.best.fields[0].tolist() == [[dot[i][j] for j in own] for i, own in enumerate(best)]

    positives = [[(dot[i][j], j) for j in own] for i, own in enumerate(best)]
    positives[0] = positives[0][:2]
    second = block_of(np, anchors, vecs[anchors], labels[anchors], positives)
    for b in buckets:
        second.meet(b)
    got = second.best.fields[3].reshape(len(anchors), 5, 10)
    for i, a in enumerate(anchors):
        for p in range(5):
            want = []
            if p < len(positives[i]):
                ps = positives[i][p][0]
                want = sorted((j for j in range(n) if labels[j] != labels[a] and 30 * ps <= 100 * dot[i][j] <= 90 * ps), key=lambda j: key(i, j))[:10]
            assert [j for j in got[i, p].tolist() if j != negatives.LAST] == want
