"""op11: collocations against plain Python counting, on small thresholds."""

import re
from collections import Counter

from corpuslens.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n string, w1 int, word double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        inside = [b for (lg, q), b in cands.items() if lg == lang and len(q) > len(p) and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        score, k = min(((2000000 * a) // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return ranked


TEXTS = [
    "New York is big. new york city, New York City! the new york times",
    "new york city hall; NEW YORK CITY\tHALL",
    "a b c d e\nA B C D E. a b c d e",
    "a b c d e a b c d f",
    None,
    "",
    "ünï cödé ünï cödé. ünï cödé",
    "x" * 5000 + " y " + "x" * 5000 + " y",
]


def test_collocations_against_plain_python(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], "x", 1, 0.5) for i, t in enumerate(TEXTS * 3)] + [(99, TEXTS[0], "en", None, None, None)] * 2
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), top=5, least=2).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: (r.lang, r.rank))] == brute(rows, 2, 5)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA), least=2).count() == 0


def test_only_phrases_of_frequent_parts_are_counted(spark):
    rare = " ".join(f"r{i}" for i in range(300))
    rows = [(i, t, "en", None, None, None) for i, t in enumerate(["new york city hall"] * 4 + ["new york bay", rare, "york r1 new york"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = phrases.counted(docs, least=4).collect()
    assert sorted((r.n, r.f) for r in counts if r.n != 0) == [(-1, 323), (1, 4), (1, 4), (1, 6), (1, 7), (2, 4), (2, 4), (2, 6), (3, 4), (3, 4), (4, 4)]
    assert sorted(r.word for r in counts if r.n == 0) == ["city", "hall", "new", "york"]
    # what a task sends: none of the 300 pairs of rare words
    words = spark.createDataFrame([r for r in counts if r.n == 1], "lang string, n byte, w1 long, w2 long, w3 long, w4 long, f long, word string")
    run = phrases._count_runs((2,), {1: phrases._bit_table(words, 1)}, False)
    sent = docs.select("text", "lang").coalesce(1).mapInArrow(run, "lang string, n byte, w1 long, w2 long, w3 long, w4 long, count long, word string")
    assert sent.count() < 30


def test_a_full_bit_table_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 16)
    monkeypatch.setattr(phrases, "BITS_PER_PHRASE", 1)
    rows = [(i, t, ["en", None][i % 2], "x", 1, 0.5) for i, t in enumerate(TEXTS * 3)]
    # every place of the table may be taken: all is counted, and the same comes out
    rows += [(1000 + i, " ".join(f"w{j}" for j in range(i, i + 40)), "en", None, None, None) for i in range(0, 400, 20)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), top=50, least=2).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: (r.lang, r.rank))] == brute(rows, 2, 50)
