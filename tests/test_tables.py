from pyspark.sql import functions as F

from corpuslens.functions.text import html_safe
from corpuslens.operators import churn, graph, rollup
from corpuslens.sources import commits, corpus, results


def paths(spark, *names):
    return spark.createDataFrame([("r", n, "x") for n in names], "repo string, file_path string, source string")


def listed(df):
    return sorted(r.file_path for r in df.collect())


def test_main_root_only(spark):
    df = paths(spark, "src/main/java/A.java", "src/test/java/ATest.java", "tools/B.java", "src/main/java/a.txt")
    assert listed(corpus.select_sources(df)) == ["src/main/java/A.java"]
    assert listed(corpus.select_sources(df, include_tests=True)) == ["src/main/java/A.java", "src/test/java/ATest.java"]


def test_whole_tree_without_main_root(spark):
    df = paths(spark, "app/A.java", "build/B.java", "x/target/C.java", "x/.git/D.java", "node_modules/E.java", "builds/F.java", "target.java")
    assert listed(corpus.select_sources(df)) == ["app/A.java", "builds/F.java", "target.java"]


def test_cap_orders_by_path_component(spark):
    m = corpus.MAIN_ROOT
    df = paths(spark, m + "a-b/Z.java", m + "a/Y.java", m + "a.java", corpus.TEST_ROOT + "A.java")
    assert listed(corpus.cap_sources(df, 1)) == [m + "a/Y.java"]
    assert listed(corpus.cap_sources(df, 2)) == [m + "a-b/Z.java", m + "a/Y.java"]
    assert corpus.cap_sources(df, 0).count() == 0
    assert corpus.cap_sources(df, None).count() == 4
    assert corpus.cap_sources(df, 3, salts=1).count() == 3


def test_read_source_tree(spark, tmp_path):
    folder = tmp_path / "corpus" / "repo1" / "src" / "main" / "java"
    folder.mkdir(parents=True)
    (folder / "A.java").write_bytes(b"class A {\r\n// \xff\r\n}\n")
    (folder / "note.txt").write_text("no")
    (row,) = corpus.read_source_tree(spark, str(tmp_path / "corpus")).collect()
    assert (row.repo, row.file_path) == ("repo1", "src/main/java/A.java")
    assert row.source == "class A {\n// �\n}\n"


def test_commit_log(spark, tmp_path):
    mark = commits.COMMIT_MARKER
    log = f"warning: x\nsub/Z.java\n{mark}2024-02-01\nsub/A.java\n\n{mark}2024-03-09\n sub/B.java \nother/C.java\n\n{mark}2024-01-01\nsub/A.java\n"
    (tmp_path / "shop.log").write_text(log)
    touched = commits.commit_touches(commits.read_commit_log(spark, str(tmp_path)))
    assert touched.count() == 4
    rows = {r.file_path: r for r in churn.churn_by_file(commits.reanchor(touched, "sub")).collect()}
    # the first log entry gives the date, not the largest date
    assert {k: (v.commit_count, v.last_modified) for k, v in rows.items()} == {
        "A.java": (2, "2024-02-01"), "B.java": (1, "2024-03-09"),
    }
    assert rows["A.java"].repo == "shop"
    assert commits.reanchor(touched, "").count() == 4


def test_no_history(spark):
    assert churn.churn_by_file(commits.no_commits(spark)).count() == 0


def graph_input(spark):
    types = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 2, "A"), ("s", 3, "C")], "repo string, type_ord bigint, class_name string")
    imports = spark.createDataFrame(
        [("r", 0, "A", "x.B"), ("r", 0, "A", "x.A"), ("r", 0, "A", "java.util.List"), ("r", 2, "A", "y.B"),
         ("r", 1, "B", "x.A"), ("r", 1, "B", "x.C")],
        "repo string, type_ord bigint, class_name string, import_path string",
    )
    return types, graph.dependency_edges(types, imports)


def test_edges(spark):
    types, edges = graph_input(spark)
    assert {(r.from_ord, r.from_class, r.to_class) for r in edges.collect()} == {(0, "A", "B"), (1, "B", "A")}
    assert {r.class_name: r.depends_on for r in graph.depends_on_lists(edges).collect()} == {"A": ["B"], "B": ["A"]}
    parts = graph.depends_on_lists(
        spark.range(5000).selectExpr("'r' repo", "id from_ord", "'Main' from_class", "concat('T', id) to_class")
    ).collect()
    assert [r.depends_on for r in parts] == [sorted(f"T{i}" for i in range(5000))]
    # both types named A carry the shared list
    ranked = graph.fan_in(types, edges).orderBy("rank").collect()
    assert [(r.class_name, r.fan_in) for r in ranked] == [("B", 2), ("A", 1)]
    detail = rollup.relied_upon_detail(
        graph.fan_in(types, edges), types.withColumn("file_path", F.concat(F.lit("f"), "type_ord"))
    )
    assert {(r.class_name, r.file_path, r.text) for r in detail.collect()} == {
        ("B", "f1", "Depended on by 2 other classes"), ("A", "f2", "Depended on by 1 other class"),
    }


def test_hotspots(spark):
    types = spark.createDataFrame(
        [("r", i, f"f{i}", n, h) for i, (n, h) in enumerate([("B", 1), ("A", 1), ("C", 0), ("A", 3), ("D", 9)])],
        "repo string, type_ord bigint, file_path string, class_name string, heavy_methods bigint",
    )
    touched = spark.createDataFrame(
        [("r", "f0", 2, "d"), ("r", "f1", 2, "d"), ("r", "f2", 1, "d"), ("r", "f3", 1, None)],
        "repo string, file_path string, commit_count bigint, last_modified string",
    )
    ranked = churn.hotspots(types, touched)
    assert [(r.class_name, r.score) for r in ranked.orderBy("rank").collect()] == [("A", 4), ("A", 4), ("B", 4), ("C", 1)]
    # a repeated name shows its last type each time
    texts = [r.text for r in rollup.hotspot_detail(ranked, types, touched).orderBy("rank").collect()]
    assert texts[0] == texts[1] == "1 commit(s) · last modified unknown · 3 high-complexity method(s)"


def test_hotspot_plan_limits_groups_before_the_exchange(spark):
    types = spark.range(10).selectExpr("cast(id % 2 as string) repo", "id type_ord", "'f' file_path", "'n' class_name", "id heavy_methods")
    touched = spark.range(1).selectExpr("cast(id as string) repo", "'f' file_path", "id + 1 commit_count", "'d' last_modified")
    plan = churn.hotspots(types, touched)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_module_key(spark):
    cases = {
        "a/services/billing/x/A.java": "billing", "services": "root", "a/services": "root", "x/y/A.java": "y",
        "A.java": "root", "services/A.java": "A.java", "a/services/services/B.java": "services",
    }
    for path, want in cases.items():
        assert one(spark, rollup.module_key, path) == want


def test_aspect_category(spark):
    cases = {
        "Uses a JWT cache": "Security & Authentication", "Throws an Exception": "Error Handling",
        "catalog": "Logging & Observability", "Spring-managed": "Configuration & Dependency Injection", "nothing": "Other",
    }
    for text, want in cases.items():
        assert one(spark, rollup.aspect_category, text) == want


def test_html_and_date(spark):
    assert one(spark, html_safe, "<a b='c'>\"&amp;</a>") == "&lt;a b=&#39;c&#39;&gt;&#34;&amp;amp;&lt;/a&gt;"
    assert one(spark, rollup.generated_at_text, "2026-01-01T00:00:00.123456+00:00") == "January 01, 2026 at 12:00 AM UTC"


def test_hit_rate(spark):
    df = spark.createDataFrame([(0, 0), (3, 235), (15, 1)], "m bigint, c bigint")
    assert [r.x for r in df.select(rollup.hit_rate_pct(F.col("m"), F.col("c")).alias("x")).collect()] == [0.0, 98.7, 6.2]


def test_finding_text(spark):
    df = spark.createDataFrame([("m", 3), ("m", None)], "m string, l bigint")
    assert [r.x for r in df.select(rollup.finding_text(F.col("m"), F.col("l")).alias("x")).collect()] == ["m (line 3)", "m"]


def test_document_sink(spark, tmp_path):
    parts = spark.createDataFrame([("r", "head", 0, 1, "{}")], "repo string, section string, part bigint, items bigint, payload string")
    results.write_document(parts, str(tmp_path / "doc"))
    back = spark.read.json(str(tmp_path / "doc"))
    assert back.first().payload == "{}"
    assert '"payload"' in spark.read.text(str(tmp_path / "doc.schema")).first().value
