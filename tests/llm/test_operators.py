"""Each operator against plain Python on small inputs: odd rows, copies, ties, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import common, components, decontaminate, language, licenses, ngram_lm, packing, pii, quality, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, score int, row string, fp int, pii int"
LOWER = str.maketrans(common.A_TO_Z, common.A_TO_Z.lower())
RARE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [
    None,
    "",
    " \n\t ",
    "One two.",
    "#### || $$$ 12 34 ... !!",
    RARE,
    f"Intro words here. {RARE.upper()} And a tail of words.",
    " ".join(f"w{k}" for k in range(3000)) + " " + RARE,
    "the cat sat on the mat and the dog ran off with the hat while it rained all day long",
    "the cat sat on the mat and the dog ran off with the hat while it rained all day long",
    "the cat sat on the mat and the dog ran off with the hat while it rained all day",
    "Ünïcödé wörds — «éàü» Ω 漢字 😀 " * 5,
    "same line here\nsame line here\nother line\nsame line here\n" * 3,
    "Licensed under the Apache License, Version 2.0. GNU General\nPublic-License; mit license",
    "mail joe.doe@mail.example.org, 4111 1111 1111 1111 and +1 (212) 555-0100",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", f"s{i % 3}", "7", 1, "r", 0, 9) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=common.SPACE_WORD_PATTERN):
    return re.findall(pattern, (text or "").translate(LOWER))


# --- shared ------------------------------------------------------------------------------


def test_words_of_rows():
    import pyarrow as pa

    texts = [t for t in TEXTS] + ["x" * 100, "a b" * 7]
    for kind, pattern in ((common.SPACE_WORDS, common.SPACE_WORD_PATTERN), (common.TEXT_WORDS, common.TEXT_WORD_PATTERN)):
        for low, high, found in common.words_of(pa.array(texts), kind):
            assert [found.text(a, b).split(" ") if b > a else [] for a, b in zip(found.bounds, found.bounds[1:])] == [words(t, pattern) for t in texts[low:high]]
            by_hash = {}
            for k in range(len(found.starts)):
                assert by_hash.setdefault(int(found.hashes[k]), found.text(k, k + 1)) == found.text(k, k + 1)


def test_mixing_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    assert (common.unmixed(common.mixed(x)) == x).all()


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}


# --- 1 -----------------------------------------------------------------------------------

ITEMS = [(1, RARE), (2, RARE), (3, "one TWO"), (4, None), (5, "  ... "), (None, "ran off with the hat"), (10, "the cat sat on the mat and the dog ran off with the hat while")]


def contaminated(text, items):
    own, hit, found = words(text, common.TEXT_WORD_PATTERN), set(), set()
    for item, t in items:
        w = words(t, common.TEXT_WORD_PATTERN)
        for s in range(max(1, len(w) - 12) if w else 0):
            window = w[s : s + 13]
            for k in range(len(own) - len(window) + 1):
                if own[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found |= {str(item)} if item is not None else set()
    return len(own), len(hit), sorted(found)


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.contamination(docs, items).collect()]
    assert Counter(map(str, found)) == Counter(str((r["doc_id"], *contaminated(r["text"], ITEMS))) for r in docs.collect())
    assert decontaminate.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [r["text"] for r in docs.collect() if not (c := contaminated(r["text"], ITEMS))[1] or 20 * c[1] < c[0]]
    assert Counter(r["text"] for r in kept.collect()) == Counter(clean)


# --- 2 -----------------------------------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    values = [
        "joe.doe99@mail.example.org", "4111 1111 1111 1111", "5500005555555559", "+1 (212) 555-0100", "212-555-0100", "10.0.200.17",
        "1984-02-29", "31.12.1999", "12/31/1999", "DE89 3704 0044 0532 0130 00", "123-45-6789", "password=0123456789abcdef",
    ]
    rows = [(k, f"before {v} after") for k, v in enumerate(values)] + [(100 + k, f"{v}") for k, v in enumerate(values)]
    out = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, value in enumerate(values):
        new = out[k]["pii"][0]["pseudonym"]
        assert out[k]["text"] == f"before {new} after" and out[100 + k]["text"] == new != value
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9a-f]" if "=" in value else "[0-9]", "0", s))  # noqa: E731, B023
        assert shape(new) == shape(value)
    assert luhn(re.sub(" ", "", out[1]["text"][7:26])) and luhn(out[102]["text"])
    assert all(0 <= int(x) <= 255 for x in out[105]["text"].split("."))
    for k, form in ((106, "%Y-%m-%d"), (107, "%d.%m.%Y"), (108, "%m/%d/%Y")):
        __import__("datetime").datetime.strptime(out[k]["text"], form)
    iban = out[109]["text"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_dates_before_times_and_secrets_of_letters(spark):
    texts = ["2024-01-15", "at 2024-01-15T10:00:00Z", "2024-01-15Z", "token=abcdefabcdef"]
    out = [r["text"] for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[0] != texts[0] and out[1:3] == [f"at {out[0]}T10:00:00Z", f"{out[0]}Z"]
    assert out[3] != texts[3] and out[3].startswith("token=")


def test_pseudonyms_are_permutations(spark):
    digits = spark.range(1000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), pii.DIGITS, F.lit("k")).alias("x"))
    assert digits.distinct().count() == 1000 and digits.where(F.length("x") != 3).isEmpty()
    days = spark.sql("SELECT date_format(date_add(DATE'1900-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS d FROM range(0, 73049, 7)")
    new = days.select(pii.pseudonym(F.col("d"), F.lit("date")).alias("d"))
    assert new.distinct().count() == days.count() and new.where("d < '1900' OR d > '2100'").isEmpty()
    other = spark.range(1).select(pii.permuted(F.lit("123456789012345678901234567890"), pii.DIGITS, F.lit("a")).alias("a"), pii.permuted(F.lit("123456789012345678901234567890"), pii.DIGITS, F.lit("b")).alias("b")).first()
    assert len(other["a"]) == 30 and other["a"] != other["b"]


def test_pseudonyms_leave_the_rest(spark, docs, empty):
    invalid = [(1, "4111111111111112 999.1.1.1 1984-02-30 000-12-3456 DE89370400440532013001 12 345 v1.2.3"), (2, None), (3, "")]
    found = pii.pseudonymised(spark.createDataFrame(invalid, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["text"], r["pii"]) for r in found] == [(*x, []) for x in invalid]
    out = pii.pseudonymised(docs)
    assert out.count() == docs.count() and sum(len(r["pii"]) for r in out.collect()) == 3
    assert pii.pseudonymised(empty).count() == 0


# --- 3 -----------------------------------------------------------------------------------


def base(text):
    text = text or ""
    own = re.findall(common.SPACE_WORD_PATTERN, text)
    grams = [tuple(own[k : k + 8]) for k in range(len(own) - 7)]
    n = Counter(grams)
    again = {j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 8)}
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(common.SPACE_WORD_PATTERN, x) and x in lines[:k])
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def test_quality(docs, empty):
    found = quality.judged(docs).collect()
    assert Counter(str((r["doc_id"], *(r[c] for c in quality.Facts._fields))) for r in found) == Counter(str((r["doc_id"], *base(r["text"]))) for r in docs.collect())
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (r["rejected_by"] is None) and not (r["base_failed"] and r["kept"])
    assert quality.judged(empty).count() == 0


def test_rules_are_ordered_by_rejections_per_second():
    costs = [dict(rule="symbols", rejected=1, seconds=1.0), dict(rule="shouting", rejected=8, seconds=2.0), dict(rule="one_word", rejected=0, seconds=0.1)]
    order = quality.rule_order(costs, quality.RULES)
    assert order[:3] == ["shouting", "symbols", "one_word"] and sorted(order) == sorted(quality.RULES)


def test_rules():
    facts = lambda t: quality.Facts(*base(t.decode()))
    for rule, bad in (("shouting", b"ABC DEF!! ghi"), ("lettered", b"12 34 -- ab"), ("one_word", b"no no no yes it is"), ("symbols", b"a | b # c"), ("repeated_lines", b"x y\nx y\nz w"), ("word_length", b"a b c d")):
        assert quality.RULES[rule](bad, facts(bad)), rule
        assert not quality.RULES[rule](b"plain words of usual length in a line", facts(b"plain words of usual length in a line"))


# --- 4 -----------------------------------------------------------------------------------


def fingerprint(text, n=4):
    own = words(text)
    shingles = [" ".join(own[k : k + n]) for k in range(max(1, len(own) - n + 1))] if own else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, empty):
    rows = docs.collect()
    prints = [fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            label[i] = min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4)
    lead = {k: min((r["doc_id"] for r, x in zip(rows, label) if x == k and r["doc_id"] is not None), default=None) for k in label}
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found) == Counter((r["doc_id"], p, lead[k]) for r, p, k in zip(rows, prints, label))
    kept = simhash.without_near_duplicates(docs, words=4, distance=4)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_connect_large_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(2)
    near = {0x0F0F << 20 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(120)}
    fps = sorted(near | {int(x) for x in rng.integers(0, 1 << 63, 60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]

    def groups(pairs):
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    mask = (1 << 64) - 1
    assert groups(links) == groups([(a, b) for a in signed for b in signed if ((a ^ b) & mask).bit_count() <= 4])


def test_near_copies_by_six_fingerprints(spark):
    rng = np.random.default_rng(5)
    texts, kin = [], []
    for group in range(30):
        own = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for copy in range(4):
            edited = list(own)
            for at in rng.integers(0, len(own), copy):
                edited[at] = "edited"
            texts.append(" ".join(edited))
            kin.append(group)
        # three fifths of the words, and so too little
        texts.append(" ".join(own[:180] + [f"v{x}" for x in rng.integers(0, 5000, 120)]))
        kin.append(1000 + group)
    prints = [simhash.majorities(t.encode(), 5, 6) for t in texts]
    assert [p[0] for p in prints] == [simhash.fingerprint(t.encode(), 5) for t in texts]
    masks = simhash.block_masks(0, 5, 7)
    assert len(masks) == 21
    meets = lambda a, b: any(x & m == y & m for x, y in zip(a[:3], b[:3]) for m in masks)
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    label = list(range(len(texts)))
    for _ in range(4):
        for i, p in enumerate(prints):
            label[i] = min(label[j] for j, q in enumerate(prints) if bits(p, q) <= 62 and meets(p, q))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()} == set(label)
    assert len(set(label)) == 60 and all(kin[x] == kin[i] for i, x in enumerate(label))


def test_near_duplicates_by_exact_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 4)
    rng = np.random.default_rng(9)
    texts = []
    for group in range(24):  # edits that leave similarities around 0.8; the last group is large
        own = [f"w{x}" for x in rng.integers(0, 5000, 200 if group else 12)]
        for copy in range(8 if group < 23 else 40):
            edited = list(own)
            for at in rng.choice(len(own), int(rng.integers(1, 8)) if group else copy % 2, replace=False):
                edited[at] = f"e{rng.integers(0, 9)}"
            texts.append(" ".join(edited))
    texts.append(texts[8] + (" " + texts[8].split()[0]) * 400)  # a repeated shingle counts once in a set
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [[j for j in range(len(texts)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(texts))]
    label = list(range(len(texts)))
    for _ in range(40):
        label = [min(label[j] for j in js) for js in near]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()} == set(label)
    assert 24 < len(set(label)) < len(texts)


# --- 5 -----------------------------------------------------------------------------------


def test_language_model_against_counts(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    teaches = common.remainder_of_id(F.col("doc_id"), 5) != 1
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [words(t) + [None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens) if not held(i)]
    c = Counter(x for t in train for x in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(c.values()), len(c)
    d = ngram_lm._discounts([sum(1 for x in pairs.values() if x == k) for k in (1, 2, 3, 4)])
    before = Counter(b for _, b in pairs)
    e = ngram_lm._discounts([sum(1 for x in before.values() if x == k) for k in (1, 2, 3, 4)])
    cut = lambda k, d: (0, *d)[min(k, 3)]
    total = {"<s>": len(train), **c}
    free = Counter()
    for (u, _), k in pairs.items():
        free[u] += cut(k, d)

    def p(u, w):
        low = (before[w] - cut(before[w], e)) / len(pairs) + sum(cut(k, e) for k in before.values()) / len(pairs) / (v + 1)
        return (pairs[u, w] - cut(pairs[u, w], d) + free[u] * low) / total[u] if total.get(u) else low

    for u in ("<s>", "the", "never met"):
        assert sum(p(u, w) for w in c) + p(u, "unknown") == pytest.approx(1)
    found = ngram_lm.scored(docs, teaches).collect()
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in found)
    want = Counter(
        (i, held(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5), round(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t)), 5))
        for (i, _), t in zip(rows, tokens)
    )
    assert got == want
    assert ngram_lm.scored(empty, teaches).count() == 0
    untaught = ngram_lm.scored(docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untaught} == {0} and all(math.isfinite(r["score"]) for r in untaught)


# --- 6 -----------------------------------------------------------------------------------


def phrases(text, sample):
    """Cross-parsing by brute force: a new phrase where no longer stretch occurs in the sample."""
    at = n = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, n = max(at + 1, end - 1), n + 1
    return n


def test_cross_parsing_counts_phrases():
    rng = np.random.default_rng(3)
    samples = {name: bytes(rng.choice(list(letters), 200).astype(np.uint8)) for name, letters in (("aa", b"abc"), ("bb", b"bcd"))}
    automata = language.build(samples)
    texts = [bytes(rng.choice(list(b"abcde"), n).astype(np.uint8)) for n in (1, 5, 60, language.STRETCH)]
    bounds = np.cumsum([0, *map(len, texts)])
    cost = language.costs(automata, np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    for k, name in enumerate(automata.names):
        assert cost[k].tolist() == pytest.approx([phrases(t, samples[name]) * math.log2(200) / len(t) for t in texts])


def test_languages(spark, docs, empty):
    rng = np.random.default_rng(4)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    rows = [(k, make(letters), lang) for k in range(12) for lang, letters in (("aa", "abcdef"), ("bb", "klmnop"), ("öö", "äöüß"))] + [(99, "x", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    automata = language.learn(train, F.col("doc_id") < 8)
    assert automata.names == ["aa", "bb", "öö"]
    found = language.identified(train.where("doc_id BETWEEN 8 AND 11").withColumnRenamed("doc_id", "d").withColumn("doc_id", F.col("lang")), automata).collect()
    assert len(found) == 12 and all(r["doc_id"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r for r in language.identified(docs, automata).collect() if r["doc_id"] is not None}
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 4)] == ["und"] * 4 and odd[0]["score"] == 0 and odd[11]["lang_pred"] != "und"
    assert language.identified(empty, automata).count() == 0
    nothing = language.learn(empty, F.lit(True))
    assert {r["lang_pred"] for r in language.identified(docs, nothing).collect()} == {"und"}


# --- 7 -----------------------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.sharded(ids, [1.0, 1.0, 2.0]).collect()
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    n = Counter(r["shard"] for r in rows)
    assert 1800 < n[2] < 2200 and 850 < n[0] < 1150 and 850 < sum(r["grown_shard"] == 3 for r in rows) * 4 / 4 < 1150

    def best(key, weights):
        draw = lambda s: -weights[s] / math.log(((xxhash.xxh64_intdigest((s).to_bytes(4, "little"), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11) + 0.5) / (1 << 53))
        return max(range(len(weights)), key=lambda s: (draw(s), -s))

    assert all(len({r["shard"] for r in rows if r["doc_id"] == k}) == 1 for k in range(5))
    out = sharding.with_slots(sharding.sharded(docs, [1.0] * 4)).collect()
    assert len(out) == docs.count()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.with_slots(sharding.sharded(empty, [1.0] * 4)).count() == 0


def test_slots_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.with_slots(sharding.sharded(rows, [1.0] * 3)).collect()
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out))) for s in range(3))


# --- 8 -----------------------------------------------------------------------------------


def test_best_fit_is_tightest_compatible():
    rng = np.random.default_rng(6)
    sizes = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    sources = [None if k % 7 == 0 else int(x) for k, x in enumerate(rng.zipf(1.5, 300) % 20)]
    clusters = rng.integers(0, 40, 300).tolist()
    bins, places = packing.best_fit(sizes, sources, clusters, 100)
    open_bins: list[list[int]] = []
    for k, (size, b) in enumerate(zip(sizes, bins)):
        fits = [
            (100 - sum(sizes[i] for i in own), n)
            for n, own in enumerate(open_bins)
            if 100 - sum(sizes[i] for i in own) >= size and not any(sources[i] == sources[k] is not None or clusters[i] == clusters[k] for i in own)
        ]
        assert b == (min(fits)[1] if fits else len(open_bins))
        if b == len(open_bins):
            open_bins.append([])
        assert places[k] == len(open_bins[b])
        open_bins[b].append(k)


def test_packing(docs, empty):
    rows = packing.packed(docs, capacity=64).collect()
    for r in rows:
        assert r["n_words"] <= 64 and (r["bin"] is None) == (r["n_words"] == 0)
    fill = Counter()
    for r in rows:
        fill[r["bin"]] += r["n_words"]
    assert max(fill.values()) <= 64
    want = Counter(len(words(r["text"])) for r in docs.collect())
    per_doc = Counter()
    for r in rows:
        per_doc[r["doc_id"]] += r["n_words"]
    assert sum(per_doc.values()) == sum(n * k for n, k in want.items()) and per_doc[7] == 3020
    assert packing.packed(empty).count() == 0


# --- 9 -----------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y and toxicity.LOOKALIKES.get(x) != y)))
    return row[-1]


def test_automaton_is_levenshtein():
    terms = ["scum", "moron", "idiot", "pathetic", "worthless", "moronic"]
    rng = np.random.default_rng(7)
    automaton = toxicity.Automaton(terms)
    tried = list(terms)
    for _ in range(600):
        word = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(len(word)))
            word[k : k + int(rng.integers(0, 2))] = ["", "x", "1", "0", "e"][rng.integers(5)]
            word = list("".join(word)) or ["a"]
        tried.append("".join(word))
    for word in tried:
        near = [(d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits_allowed(t)]
        assert automaton.match(word) == (min(near)[::-1] if near else None), word


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(8)
    filler = lambda: ["".join(rng.choice(list("abcdeghklu"), 6)) for _ in range(12)]
    rows = []
    for k in range(200):
        own = filler()
        if k % 2:
            own[k % 12] = ("moron", "pathetic")[k // 2 % 2]
        rows.append((k, " ".join(own), k % 2))
    labels = spark.createDataFrame([(k, t) for k, _, t in rows] + [(None, 1), (7, None), (7, 1)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(texts, labels, F.lit(True))
    assert set(model.terms) == {"moron", "pathetic"}
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(texts, model).collect()}
    assert all((found[k] >= 0.5) == bool(t) for k, _, t in rows)
    odd = [(1, "what a pathetlc thing"), (2, 'he said "moron" in the story'), (3, "you moron"), (4, None), (5, ""), (5, ""), (6, "M0R0N")]
    scores = [r["score"] for r in toxicity.scored(spark.createDataFrame(odd, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert scores[0] >= 0.5 > scores[1] and scores[2] >= 0.5 and scores[3:6] == [toxicity.CLEAN] * 3 and scores[6] >= 0.5
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.scored(empty, model).count() == 0
    unlearned = toxicity.learn(texts, labels.limit(0), F.lit(True))
    assert unlearned.terms == {} and {r["score"] for r in toxicity.scored(texts, unlearned).collect()} == {toxicity.CLEAN}


# --- 10 ----------------------------------------------------------------------------------


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["mit"]
    near = " ".join(w for k, w in enumerate(mit.split()) if k % 10)
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    more = spark.createDataFrame([(100, f"x y z\n{mit}\nend"), (101, f"some {near} more"), (102, half)], "doc_id long, text string")
    rows = licenses.scanned(docs.select("doc_id", "text").union(more)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert (by[13]["n_base"], by[13]["first_word"], by[13]["base_labels"]) == (3, 3, "apache,gpl,mit") and by[13]["score"] == 1
    assert by[100]["labels"] == "mit" and by[100]["score"] == 1 and by[100]["n_base"] == 0 and by[100]["first_word"] is None
    assert by[101]["labels"] == "mit" and 0.8 <= by[101]["score"] < 1 and by[102]["labels"] == ""
    assert sorted(r["n_words"] for r in rows if r["doc_id"] in range(15)) == sorted(len(words(t, common.TEXT_WORD_PATTERN)) for t in [*TEXTS, TEXTS[8], TEXTS[8]])
    assert licenses.scanned(empty).count() == 0


def test_best_block_against_all_blocks():
    rng = np.random.default_rng(9)
    text = {"t": "a b c d e f g h"}
    found = licenses.templates_for({}, text)[0]
    for _ in range(200):
        own = rng.choice(list("abcdefghxyz"), 40).tolist()
        blocks = [len(found.vocabulary & set(own[k : k + 8])) for k in range(33)]
        want = max(blocks) if max(blocks) >= found.needed else 0
        assert licenses.best_block(own, [k for k, w in enumerate(own) if w in found.prefix], found) == want


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
