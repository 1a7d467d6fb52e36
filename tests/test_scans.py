import random
import re

from pyspark.sql import functions as F

from corpuslens.functions import patterns as P
from corpuslens.functions.text import matches_with_line
from corpuslens.operators import scans


def scan(spark, text, start=1, **kw):
    df = spark.createDataFrame([("r", text, start)], "repo string, body string, start_line bigint")
    return [(r.category, r.line, r.message) for r in scans.scan(df, **kw).orderBy("finding_ord").collect()]


def test_secret(spark):
    text = 'class A {\n  private String apiKey = "sk-1";\n string My_Token\n = "a\nb";\n}'
    got = scan(spark, text, 10)
    assert [(c, n) for c, n, _ in got] == [("hardcoded_secret", 11), ("hardcoded_secret", 12)]
    assert "'apiKey'" in got[0][2] and "'My_Token'" in got[1][2]


def test_secret_placeholders(spark):
    values = ["", "  ", "changeme", "CHANGEME", "xxx", "XXXXX", "todo", "placeholder", "${TOKEN}", " ${a} "]
    assert scan(spark, "".join(f'String token = "{v}";\n' for v in values)) == []
    assert len(scan(spark, 'String token = "xx";\nString token = "$TOKEN";')) == 2


def test_comments_are_scanned_too(spark):
    assert len(scan(spark, '// String password = "p"\n')) == 1


def test_sql_concat(spark):
    lines = [
        'String q = "SELECT * FROM t WHERE id = " + id;',
        'String q = "SELECT 1";',
        'String q = "selection" + x;',
        'a("x" + "delete  from t");',
        'String q = "INSERT into t" + v + "SELECT";',
        'f("a" + SELECT + "b");',
        'SELECT + "b"',
    ]
    got = scan(spark, "\n".join(lines), 5)
    # between two literals the closing and opening quotes enclose the keyword as well
    assert [n for c, n, _ in got if c == "sql_injection_risk"] == [5, 8, 9, 10]


def test_catch(spark):
    text = (
        "try { a(); } catch (A e) { }\n"
        "try { a(); } catch (A | B e) {\n  // nothing\n /* at\n all */ }\n"
        "try { a(); } catch (A e) { log(e); }\n"
        "try { a(); } catch (A e) { if (x) { } }\n"
    )
    assert [n for _, n, _ in scan(spark, text)] == [1, 2]


def test_rule_order(spark):
    text = 'catch (E e) {}\n"SELECT " + x\nString secret = "s"'
    assert [c for c, _, _ in scan(spark, text)] == [
        "hardcoded_secret", "sql_injection_risk", "empty_catch_block",
    ]


def test_clean_text(spark):
    assert scan(spark, "class A {\n  int x = 1 + 2;\n}") == []


def test_sql_literal_against_backtracking_pattern(spark):
    plain = re.compile(
        r'"(?:[^"\\]|\\.)*\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b(?:[^"\\]|\\.)*"', re.IGNORECASE
    )
    rng = random.Random(3)
    parts = ['"', "\\", " ", "SELECT", "update", "insert  into", "delete", "from", "x", "é", "_", "+"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(F.regexp_like("t", F.lit(P.SQL_LITERAL)).alias("h")).collect()]
    assert got == [bool(plain.search(t)) for t in texts]
    assert sum(got) > 400


def test_match_lines_against_model(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "\n", "b\na", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [
        [(h.text, h.line) for h in r.h]
        for r in df.select(matches_with_line(F.col("t"), r"b\n?a|ab", F.lit(4)).alias("h")).collect()
    ]
    want = [
        [(m.group(), 4 + t.count("\n", 0, m.start())) for m in re.finditer(r"b\n?a|ab", t)] for t in texts
    ]
    assert got == want


def test_many_matches_in_one_text(spark):
    df = spark.createDataFrame([("r", 'String token = "v";\n' * 5000, 1)], "repo string, body string, start_line bigint")
    row = scans.scan(df).agg(F.count("*").alias("n"), F.max("line").alias("m")).first()
    assert (row.n, row.m) == (5000, 5000)
