import random

from pyspark.sql import functions as F

from corpuslens.operators import batching


def walk(costs, ceiling, size):
    """Sequential packing: [(batch number, index of the batch's first row)]."""
    out, number, first, count, total = [], -1, None, 0, 0
    for i, cost in enumerate(costs):
        if cost > ceiling:
            number, count, total = number + 1, 0, 0
            out.append((number, i))
            continue
        if count == 0 or total + cost > ceiling or count >= size:
            number, first, count, total = number + 1, i, 0, 0
        out.append((number, first))
        count, total = count + 1, total + cost
    return out


def test_packing_equals_the_sequential_walk(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(40):
        n = rng.choice([1, 2, 5, 30, 200])
        costs = [rng.choice([1, 2, 3, 5, 9, 10, 11, 25]) for _ in range(n)]
        ords = sorted(rng.sample(range(n * 3), n))
        rows += [("r", f"d{g}", o, c) for o, c in zip(ords, costs, strict=True)]
        for o, (number, first) in zip(ords, walk(costs, 10, 4), strict=True):
            want[(f"d{g}", o)] = (number, ords[first])
    df = spark.createDataFrame(rows, "repo string, dir string, ord bigint, cost bigint")
    for chunk in (1, 3, 7, 50, 10_000):
        for parts in (1, 16):
            got = batching.greedy_batches(
                df.repartition(parts), ["repo", "dir"], 10, 4, F.floor(F.col("ord") / chunk)
            ).collect()
            assert {(r.dir, r.ord): (r.batch_no, r.batch_ord) for r in got} == want


def test_size_cap_and_ceiling(spark):
    rows = [("r", "d", i, 1) for i in range(13)] + [("r", "e", i, 30) for i in range(4)]
    df = spark.createDataFrame(rows, "repo string, dir string, ord bigint, cost bigint")
    got = batching.greedy_batches(df, ["repo", "dir"], 60, 6).groupBy("dir", "batch_ord").count()
    assert sorted((r.dir, r["count"]) for r in got.collect()) == [("d", 1), ("d", 6), ("d", 6), ("e", 2), ("e", 2)]


def split_model(head, pieces, ceiling):
    parts = []
    for piece in pieces:
        joined = head + "".join(parts[-1] if parts else []) + piece + "\n}"
        if parts and max(1, len(joined) // 4) <= ceiling:
            parts[-1].append(piece)
        else:
            parts.append([piece])
    return [head + "".join(p) + "\n}" for p in parts]


def test_split_keeps_every_piece(spark):
    rng = random.Random(2)
    cases = []
    for i in range(300):
        pieces = ["p" * rng.choice([1, 5, 30, 200]) for _ in range(rng.randint(0, 40))]
        cases.append((i, "h" * rng.randint(1, 60), pieces))
    df = spark.createDataFrame(cases, "id bigint, head string, pieces array<string>").withColumn(
        "text", F.concat("head", F.array_join("pieces", ""), F.lit("\n}"))
    )
    got = {}
    for r in batching.split_oversized(df, ceiling=25).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r.part_text)
    for i, head, pieces in cases:
        whole = head + "".join(pieces) + "\n}"
        assert got.get(i, []) == (split_model(head, pieces, 25) if len(whole) // 4 > 25 else [])


def types_and_methods(spark, sizes):
    types = spark.createDataFrame(
        [("r", i, f"a/b/T{i}.java", "p", f"T{i}", "other", None) for i in range(len(sizes))],
        "repo string, type_ord bigint, file_path string, package string, class_name string, class_type string, javadoc string",
    ).withColumn("annotations", F.expr("array(named_struct('name', 'Service', 'arguments', array('a', 'b')))"))
    methods = spark.createDataFrame(
        [
            ("r", i, j, f"void m{j}()", "Doc." if j == 0 else None, 3, 12 if j == 1 else 2, j == 1)
            for i, n in enumerate(sizes)
            for j in range(n)
        ],
        "repo string, type_ord bigint, method_ord bigint, signature string, javadoc string, loc bigint, "
        "cyclomatic bigint, high_complexity boolean",
    ).withColumn("annotations", F.expr("cast(array() as array<struct<name:string,arguments:array<string>>>)"))
    return types, methods


def test_render(spark):
    types, methods = types_and_methods(spark, [2, 0])
    rows = batching.render_types(types, methods).orderBy("type_ord").collect()
    assert rows[0].text == (
        "@Service(a, b) class T0 (package: p, type: other, file: a/b/T0.java) {"
        "\n    /** Doc. */\n    void m0();  // loc=3, cyclomatic~=2"
        "\n    void m1();  // loc=3, cyclomatic~=12 [HIGH COMPLEXITY]\n}"
    )
    assert rows[1].text.endswith("{\n}")


def test_build_batches(spark):
    types, methods = types_and_methods(spark, [1, 40, 1, 1])
    rendered = batching.render_types(types, methods)
    members = batching.build_batches(rendered, ceiling=200, size=6, ord_bits=0)
    prompts = batching.batch_prompts(members)
    assert prompts.filter("length(prompt) div 4 > 200").count() == 0
    text = "".join(r.prompt for r in prompts.filter("batch_ord = 1").collect())
    assert all(f"void m{j}();" in text for j in range(40))
    joined = prompts.filter("batch_ord = 2").first()
    assert joined.members == 2 and joined.prompt.count("\n\n@Service") == 1
