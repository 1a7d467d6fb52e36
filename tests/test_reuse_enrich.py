import hashlib
import json

from pyspark.sql import functions as F

from corpuslens.operators import enrich, reuse
from corpuslens.sources import results


def test_content_key(spark):
    df = spark.createDataFrame([("é x",)], "t string")
    row = df.select(reuse.content_key(F.col("t")).alias("a"), reuse.content_key(F.col("t"), "v2").alias("b")).first()
    assert row.a == hashlib.sha256("v1:é x".encode()).hexdigest() and row.a != row.b


def entry(key, text):
    return (key, "A", text, [("void a()", "does a")], ["x", "x"])


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store" / "v1")
    assert results.read_results(spark, path).count() == 0
    old = spark.createDataFrame([entry("k1", "old"), entry("k2", "old")], results.RESULT_SCHEMA)
    results.write_results(old, path)
    assert results.read_results(spark, path, refresh=True).count() == 0
    new = spark.createDataFrame([entry("k2", "new"), entry("k3", "new")], results.RESULT_SCHEMA)
    merged = results.upsert_results(results.read_results(spark, path), new)
    assert {(r.cache_key, r.description) for r in merged.collect()} == {("k1", "old"), ("k2", "new"), ("k3", "new")}


def test_corrupt_store_is_a_cold_start(spark, tmp_path):
    path = tmp_path / "store"
    path.mkdir()
    (path / "part-0.parquet").write_text("this is no parquet file")
    assert results.read_results(spark, str(path)).count() == 0


def test_hits_misses_and_stats(spark):
    keyed = spark.createDataFrame([("r", 1, "a"), ("r", 2, "a"), ("s", 3, "b")], "repo string, id bigint, cache_key string")
    store = spark.createDataFrame([("a", "N", "d")], "cache_key string, class_name string, description string")
    hits, misses = reuse.split_by_store(keyed, store)
    assert sorted(r.id for r in hits.collect()) == [1, 2]
    assert [r.id for r in misses.collect()] == [3]
    stats = {r.repo: (r.hits, r.misses) for r in reuse.store_stats(keyed, store).collect()}
    assert stats == {"r": (2, 0), "s": (0, 1)}
    assert reuse.store_stats(keyed, store.limit(0)).filter("hits > 0").count() == 0


def test_failures_are_contained(spark):
    def call(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return ('{"classes": []}' if prompt == "ok" else "garbage"), 5, 7

    prompts = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "bad")], "id bigint, prompt string")
    parsed = enrich.parse_responses(enrich.enrich_batches(prompts, call, ["id"]))
    rows = {r.id: r for r in parsed.collect()}
    assert rows[1].error is None and rows[1].classes == []
    assert rows[2].error == "call failed: down" and rows[2].input_tokens is None
    assert rows[3].error == "response failed schema validation" and rows[3].input_tokens == 5
    totals = enrich.usage_totals(parsed.withColumn("model", F.lit("m")), ["model"]).first()
    assert (totals.calls_made, totals.input_tokens, totals.output_tokens) == (2, 10, 14)


def parse(spark, *docs):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    rows = df.select("i", enrich.parse_response(F.col("t")).alias("p")).orderBy("i").collect()
    return [(r.p.valid if r.p else False, r.p.repaired if r.p else None, r.p.classes if r.p else None) for r in rows]


def test_response_forms(spark):
    one = {"class_name": "A", "description": "d", "methods": [{"signature": "s", "description": "m"}], "notable_aspects": ["x"]}
    bare = {"class_name": "A", "description": "[1, 2]"}
    got = parse(
        spark,
        {"classes": [one]},
        {"classes": json.dumps([one])},
        {"classes": [{**one, "methods": json.dumps(one["methods"])}]},
        {"classes": json.dumps([{**one, "notable_aspects": json.dumps(["x"])}])},
        {"classes": [bare]},
        {"classes": json.dumps([bare])},
        {"classes": json.dumps([{**bare, "description": "[not json"}])},
        {"classes": [{"class_name": "A"}]},
        {"classes": "no list"},
        {"other": 1},
        "not json",
        {"classes": [{**one, "methods": [{"signature": "s"}]}]},
    )
    assert [g[0] for g in got] == [True, True, True, True, True, False, True, False, False, False, False, False]
    assert [g[1] for g in got[:7]] == [False, True, True, True, False, True, True]
    for g in got[:4]:
        (c,) = g[2]
        assert (c.class_name, c.methods[0].signature, c.notable_aspects) == ("A", "s", ["x"])
    assert got[4][2][0].methods == [] and got[4][2][0].notable_aspects == []


def test_match_back(spark):
    members = spark.createDataFrame(
        [("r", "d", 1, 0, 1, "f1", "A"), ("r", "d", 1, 0, 2, "f2", "A"), ("r", "d", 3, 0, 3, "f3", "A")],
        "repo string, dir string, batch_ord bigint, part int, type_ord bigint, file_path string, class_name string",
    )
    answers = spark.createDataFrame(
        [("r", "d", 1, 0, [("A", "one", [], []), ("B", "two", [], [])]), ("r", "d", 3, 0, None)],
        f"repo string, dir string, batch_ord bigint, part int, classes array<{enrich.CLASS_STRUCT}>",
    )
    got = enrich.match_back(answers, members).collect()
    assert [(r.type_ord, r.file_path, r.description) for r in got] == [(2, "f2", "one")]


def test_merge_fragments(spark):
    df = spark.createDataFrame(
        [
            (1, 2, "second", [("b", "B2"), ("a", "A2")], ["y", "x"]),
            (1, 1, "first", [("a", "A1")], ["x", "z"]),
            (2, 1, "only", [], ["q", "q"]),
        ],
        "id bigint, frag_ord bigint, description string, methods array<struct<signature:string,description:string>>, notable_aspects array<string>",
    )
    records, methods, aspects = enrich.merge_fragments(df, ["id"])
    assert {(r.id, r.description, r.fragments) for r in records.collect()} == {(1, "first", 2), (2, "only", 1)}
    assert [r.signature for r in methods.filter("id = 1").orderBy("frag_ord", "pos").collect()] == ["a", "b", "a"]
    assert [r.aspect for r in aspects.filter("id = 1").orderBy("seen").collect()] == ["x", "z", "y"]
    assert [r.aspect for r in aspects.filter("id = 2").collect()] == ["q", "q"]
    last = {r.signature: r.description for r in enrich.last_method_texts(methods, ["id"]).collect()}
    assert last == {"a": "A2", "b": "B2"}
    assert [r.id for r in reuse.admissible(df, ["id"]).collect()] == [2]


def test_overview(spark):
    repos = spark.createDataFrame([("r",), ("s",)], "repo string")
    readme = spark.createDataFrame([("r", "README.md", "Hello")], "repo string, file_path string, excerpt string")
    build = readme.limit(0)
    types = spark.createDataFrame([("r", i, f"T{i}", "dto") for i in range(5)], "repo string, type_ord bigint, class_name string, class_type string")
    described = types.filter("type_ord <> 3").select("repo", "type_ord", F.lit("does").alias("description"))
    parts = enrich.overview_input(repos, readme, build, types, described, F.floor(F.col("type_ord") / 2))
    rows = parts.filter("repo = 'r'").orderBy("part").collect()
    assert rows[0].text + "\n".join(r.text for r in rows[1:]) == (
        "README:\nHello\n\nBuild file (dependencies):\n(none found)\n\nClass purposes:\n"
        "- T0 (dto): does\n- T1 (dto): does\n- T2 (dto): does\n- T4 (dto): does"
    )
    none = spark.createDataFrame(
        [], "repo string, name string, description string, tech_stack array<string>, architecture_summary string, main_modules array<string>"
    )
    row = enrich.with_overview(repos, none).filter("repo = 's'").first()
    assert (row.name, row.tech_stack, row.architecture_summary) == ("s", [], "")
    assert row.description.startswith("Overview generation failed")


def test_cost(spark):
    totals = spark.createDataFrame([("medium", 1_000_000, 2_000_000), ("new", 1_000_000, 1_000_000)], "model string, input_tokens bigint, output_tokens bigint")
    got = {r.model: r.cost_usd for r in enrich.usage_cost(totals, enrich.TIER_PRICES).collect()}
    assert got == {"medium": 33.0, "new": 6.0}
