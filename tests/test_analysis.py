import json
import re

import pytest

from corpuslens.plans.analysis import Options, analyze
from corpuslens.sources import results
from tests import samples

CONTROLLER = "src/main/java/org/shop/services/orders/controller/OrderApi.java"


def describe(prompt):
    """Describes each class of a prompt; every other field comes as text in a text."""
    classes = []
    for name, body in re.findall(r"class (\w+) \(package.*?\{(.*?)\n\}", prompt, re.S):
        signatures = re.findall(r"\n    (?:@\S+\(.*?\) )*([^/@\n][^;\n]*);", body)
        classes.append(
            {
                "class_name": name,
                "description": f"{name} described",
                "methods": [{"signature": s, "description": f"{s} does"} for s in signatures],
                "notable_aspects": ["Uses a cache", "Uses a cache"] if name == "OrderApi" else [],
            }
        )
    if "class Painter" in prompt:
        raise RuntimeError("no answer")
    return json.dumps({"classes": json.dumps(classes)}), len(prompt) // 4, 10


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("shop", 0, CONTROLLER, samples.ORDER_API),
        ("shop", 1, "src/main/java/org/shop/dto/Outer.java", samples.NESTED),
        ("shop", 2, "src/main/java/org/shop/Painter.java", samples.ARROW),
        ("shop", 3, "src/main/java/org/shop/Broken.java", samples.BROKEN),
        ("shop", 4, "src/main/java/org/shop/OrderStore.java", 'class OrderStore { String token = "t0"; }\n'),
    ]
    files = spark.createDataFrame(rows, "repo string, file_ord bigint, file_path string, source string")
    commits = spark.createDataFrame(
        [("shop", 0, "2024-05-02", CONTROLLER), ("shop", 1, "2024-05-09", CONTROLLER)],
        "repo string, commit_ord bigint, date string, file_path string",
    )
    return files, commits


def run(spark, corpus, store=None, **options):
    files, commits = corpus
    store = store or spark.createDataFrame([], results.RESULT_SCHEMA)
    return analyze(files, commits, store, describe, options=Options(**options))


def test_whole_run(spark, corpus):
    a = run(spark, corpus)
    assert a.errors.count() == 1
    rows = {r.class_name: r for r in a.assembled.collect()}
    assert set(rows) == {"OrderApi", "Outer", "Left", "Right", "Local", "Port", "Color", "Painter", "OrderStore"}
    api = rows["OrderApi"]
    assert api.description == "OrderApi described"
    assert api.depends_on == ["OrderStore"]
    assert api.notable_aspects == ["Uses a cache", "Uses a cache"]  # one fragment stays as it came
    assert api.churn.commit_count == 2 and api.churn.last_modified == "2024-05-02"
    assert [m.description for m in api.methods] == [f"{m.signature} does" for m in api.methods]
    assert rows["Painter"].description == "Description unavailable." and rows["Painter"].churn is None
    assert [f.category for f in rows["OrderStore"].security_findings] == ["hardcoded_secret"]
    meta = a.metadata.first()
    assert (meta.total_files_parsed, meta.parse_errors, meta.calls_cached, meta.security_findings_total) == (4, 1, 0, 1)
    assert meta.calls_made == a.responses.filter("error is null").count()
    sections = {r.section for r in a.document.collect()}
    assert sections == {"head", "classes", "dependency_graph", "hotspots", "parse_errors"}
    classes = [c for r in a.document.filter("section = 'classes'").orderBy("part").collect() for c in json.loads(r.payload)]
    assert [c["class_name"] for c in classes][0] == "OrderApi" and len(classes) == 9
    head = json.loads(a.document.filter("section = 'head'").first().payload)
    assert head["schema_version"] == "1.1" and head["project"]["name"] == "shop"
    categories = {r.category for r in a.report.collect()}
    assert {"Security Findings", "Notable Aspects", "Most Relied-Upon Classes"} <= categories


def test_second_run_uses_the_store(spark, corpus, tmp_path):
    first = run(spark, corpus)
    results.write_results(first.store, str(tmp_path / "v1"))
    second = run(spark, corpus, results.read_results(spark, str(tmp_path / "v1")))
    meta = second.metadata.first()
    # only the types of the batch that failed are asked for again
    assert meta.calls_cached == 7
    assert {r.class_name for r in second.batches.collect()} == {"Painter", "OrderStore"}
    same = [x for x in ("description", "notable_aspects", "methods")]
    left = {r.class_name: [r[c] for c in same] for r in first.assembled.collect()}
    right = {r.class_name: [r[c] for c in same] for r in second.assembled.collect()}
    assert left == right
    assert run(spark, corpus, results.read_results(spark, str(tmp_path / "v1")), prompt_version="v2").metadata.first().calls_cached == 0


def test_split_type_is_merged_and_not_stored(spark, corpus):
    a = run(spark, corpus, token_ceiling=80)
    parts = a.batches.filter("class_name = 'OrderApi'").count()
    assert parts > 1
    api = a.assembled.filter("class_name = 'OrderApi'").first()
    assert [m.description for m in api.methods] == [f"{m.signature} does" for m in api.methods]
    assert api.notable_aspects == ["Uses a cache"]
    assert "OrderApi" not in {r.class_name for r in a.store.collect()}


def test_checkpoint_folder_is_used(spark, corpus, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert run(spark, corpus).types.count() == 9
    assert any(tmp_path.rglob("part-*"))
