import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import mask_code, normalize_newlines, source_lines
from corpuslens.operators import extract
from corpuslens.operators.metrics import cyclomatic, method_metrics
from corpuslens.sources import corpus
from tests import samples


def files(spark, *texts, path="src/main/java/org/F{}.java"):
    rows = [("r", i, path.format(i), text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "repo string, file_ord bigint, file_path string, source string")


def parse(spark, *texts, **kw):
    return extract.parse_files(files(spark, *texts), docs=True, metrics=True, findings=True, **kw)


def test_controller_facts(spark):
    p = parse(spark, samples.ORDER_API)
    (t,) = extract.type_table(p).collect()
    assert (t.package, t.class_name, t.kind, t.class_type) == (
        "org.shop.services.orders.controller", "OrderApi", "class", "controller",
    )
    assert t.javadoc == "Serves orders.\n<p>Read only."
    assert (t.start_line, t.end_line, t.n_methods) == (14, 45, 4)
    assert [(a.name, a.arguments) for a in t.annotations] == [
        ("RestController", []), ("RequestMapping", ["/orders/"]),
    ]
    m = {r.name: r for r in extract.method_table(p).collect()}
    assert m["OrderApi"].signature == "void OrderApi(OrderStore store)"
    assert m["OrderApi"].method_ord == 0
    assert m["OrderApi"].javadoc == "Wires the store."
    assert m["one"].signature == "OrderView one(Long id)"
    assert m["one"].modifiers == ["public"]
    assert m["one"].javadoc == "One order."
    assert (m["one"].start_line, m["one"].end_line, m["one"].loc) == (26, 34, 9)
    assert m["one"].cyclomatic == 4 and not m["one"].high_complexity
    assert m["search"].signature == "Map search(Map filter, String words)"
    assert m["search"].annotations[0].arguments == ["method=RequestMethod.POST", "value=search"]
    assert m["create"].signature == "void create(java when, int sizes)"
    assert m["create"].start_line == m["create"].end_line == 44
    assert "go" not in m


def test_routes(spark):
    p = parse(spark, samples.ORDER_API)
    rows = extract.route_table(p).orderBy("endpoint_ord").collect()
    assert [(r.http_method, r.path) for r in rows] == [
        ("GET", "/orders/{id}"), ("REQUEST", "/orders/search"), ("POST", "/orders"),
    ]


def test_route_root_and_argument_with_equals(spark):
    text = """class A {
    @GetMapping void a() {}
    @GetMapping("x=y") void b() {}
    @GetMapping(path = "p") void c() {}
}
"""
    p = parse(spark, text)
    rows = extract.route_table(p).orderBy("endpoint_ord").collect()
    # an argument holding '=' is skipped unless it is value= or path=
    assert [r.path for r in rows] == ["/", "/", "/p"]


def test_imports_are_shared_by_all_types_of_a_file(spark):
    p = parse(spark, "import a.B;\nimport static c.D.*;\nclass X { class Y {} }\n")
    rows = extract.import_table(p).orderBy("type_ord", "import_path").collect()
    assert [(r.class_name, r.import_path) for r in rows] == [
        ("X", "a.B"), ("X", "c.D"), ("Y", "a.B"), ("Y", "c.D"),
    ]


def test_nested_types_and_kind_order(spark):
    p = parse(spark, samples.NESTED)
    types = extract.type_table(p).orderBy("type_ord").collect()
    assert [(t.class_name, t.kind) for t in types] == [
        ("Outer", "class"), ("Left", "class"), ("Right", "class"), ("Local", "class"),
        ("Port", "interface"), ("Color", "enum"),
    ]
    methods = extract.method_table(p).orderBy("type_ord", "method_ord").collect()
    assert [(m.class_name, m.signature) for m in methods] == [
        ("Left", "int a()"), ("Right", "Map pair(Map e)"), ("Right", "void send(String s)"),
        ("Local", "void l()"), ("Port", "void send(String s)"), ("Color", "void Color()"),
        ("Color", "void Color(String s)"),
    ]
    assert all(t.class_type == "other" for t in types)


def test_arrow_switch_keeps_lines(spark):
    p = parse(spark, samples.ARROW)
    rows = {m.name: m for m in extract.method_table(p).collect()}
    assert set(rows) == {"draw", "sides"}
    assert rows["sides"].start_line == 16
    assert rows["draw"].cyclomatic == 3


def test_broken_file_is_set_aside(spark):
    p = parse(spark, samples.BROKEN, samples.ARROW, "class A { } }", "class B { } trailing", "", "// only a note")
    errors = {r.file_ord: r.error for r in extract.file_errors(p).collect()}
    assert set(errors) == {0, 2, 3}
    assert errors[0].startswith("src/main/java/org/F0.java: ")
    assert {t.class_name for t in extract.type_table(p).collect()} == {"Painter"}


def test_braces_in_a_last_comment(spark):
    p = parse(spark, "class A { } // }", "class B { } // {", "class C { } /* } */", "class D { } // ;")
    assert extract.file_errors(p).count() == 0
    assert {(t.class_name, t.end_line) for t in extract.type_table(p).collect()} == {
        ("A", 1), ("B", 1), ("C", 1), ("D", 1),
    }


def test_bodiless_members_and_fields(spark):
    text = """abstract class A {
    int n = of(1); /* one */ String s;
    abstract int a(int x); protected abstract
        void b();
    native long c() throws E;
    B d = new B(1, 2) { void no() { f(); } };
    { g(); } static { h(); }
    void e() { for (int i = 0; i < 3; i++) { j(i); } }
}
"""
    p = parse(spark, text)
    rows = extract.method_table(p).orderBy("method_ord").collect()
    assert [(m.signature, m.start_line, m.end_line, m.modifiers) for m in rows] == [
        ("int a(int x)", 3, 3, ["abstract"]), ("void b()", 4, 4, ["abstract", "protected"]),
        ("long c()", 5, 5, ["native"]), ("void e()", 8, 8, []),
    ]


def test_doc_comment_gap(spark):
    near = "/** Near. */\n" + "int x;" + " " * 300 + "\nclass A {}\n"
    far = "/** Far. */\n" + "int x" + "y" * 200 + ";\nclass B {}\n"
    none = "/** */\nclass C {}\n"
    docs = {t.class_name: t.javadoc for t in extract.type_table(parse(spark, near, far, none)).collect()}
    assert docs == {"A": "Near.", "B": None, "C": None}


def test_two_declarations_on_one_line(spark):
    text = "class A { void a() { x(); } void b() {\n y(); }\n}\n"
    p = parse(spark, text)
    rows = {m.name: (m.start_line, m.end_line) for m in extract.method_table(p).collect()}
    # braces are counted from the start of the line, where the type's own brace opens
    assert rows == {"a": (1, 3), "b": (1, 3)}


def test_role_precedence(spark):
    rows = [
        ("a/config/service/X.java", ["Entity", "Service"]), ("a/config/service/X.java", []),
        ("Service/X.java", []), ("a/servicex/X.java", []), ("src/exception/X.java", ["Foo"]),
    ]
    df = spark.createDataFrame(rows, "p string, n array<string>").withColumn(
        "a", F.transform("n", lambda n: F.struct(n.alias("name")))
    )
    got = [r.role for r in df.select(extract.class_role(F.col("p"), F.col("a")).alias("role")).collect()]
    assert got == ["entity", "service", "service", "other", "exception"]


TOKENS = ['"', "'", "\\", "//", "/*", "*/", "\n", "if", " ", "x", "{", "}", ";", "&&", "case", "é", "while"]


def model_mask(text):
    """Independent model: scan with str.find from token to token."""
    out, i = [], 0
    while i < len(text):
        if text.startswith("//", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            out.append(" ")
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            out.append(" ")
        elif text[i] in "\"'":
            quote, i = text[i], i + 1
            while i < len(text) and text[i] != quote:
                i += 2 if text[i] == "\\" else 1
            i += 1
            out.append(" ")
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_mask_against_model(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(mask_code(F.col("t")).alias("m")).collect()]
    assert got == [model_mask(t) for t in texts]


def test_mask_survives_long_literals(spark):
    df = spark.createDataFrame([('"' + "\\n" * 200_000 + '" if',)], "t string")
    row = df.select(cyclomatic(F.col("t")).alias("c")).first()
    assert row.c == 2


def model_block_end(lines, start):
    depth, started, text, line = 0, False, model_mask_keep("\n".join(lines[start - 1:])), start
    for ch in text:
        if ch == "\n":
            line += 1
        elif ch == "{":
            depth, started = depth + 1, True
        elif ch == "}":
            depth -= 1
            if started and depth == 0:
                return line
        elif ch == ";" and not started:
            return line
    return len(lines)


def model_mask_keep(text):
    """As model_mask, but a masked stretch leaves its newlines."""
    out, i = [], 0
    while i < len(text):
        j = i
        if text.startswith("//", i):
            end = text.find("\n", i)
            j = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            j = len(text) if end < 0 else end + 2
        elif text[i] in "\"'":
            quote, j = text[i], i + 1
            while j < len(text) and text[j] != quote:
                j += 2 if text[j] == "\\" else 1
            j = min(j + 1, len(text))
        if j > i:
            out.append("\n" * text[i:j].count("\n"))
            i = j
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_block_end_against_model(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(2000):
        text = "".join(rng.choice(TOKENS) for _ in range(rng.randint(1, 50))).strip("\n") or "x"
        cases.append((text, rng.randint(1, text.count("\n") + 1)))
    df = spark.createDataFrame(cases, "t string, s bigint").withColumn("l", source_lines(F.col("t")))
    got = [r.e for r in df.select(extract.block_end_line(F.col("l"), F.col("s")).alias("e")).collect()]
    assert got == [model_block_end(t.split("\n"), s) for t, s in cases]


def test_newlines(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n",)], "t string")
    assert df.select(source_lines(normalize_newlines(F.col("t"))).alias("l")).first().l == ["a", "b", "c"]


def test_order_and_partitions_do_not_matter(spark):
    texts = [samples.ORDER_API, samples.NESTED, samples.ARROW, samples.BROKEN]
    one = extract.method_table(extract.parse_files(files(spark, *texts).repartition(1))).collect()
    many = extract.method_table(extract.parse_files(files(spark, *texts).repartition(16))).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_annotation_arguments(spark):
    cases = {
        "": [], "()": [], '("x")': ["x"], "(A.B)": ["A.B"], '(value = "x", n = 3)': ["value=x", "n=3"],
        '(value = {"a", "b"}, c = "d,e")': ['value={"a", "b"}', "c=d,e"], '("a,b")': ["a,b"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = [r.v for r in df.select(extract.annotation_arguments(F.col("a")).alias("v")).collect()]
    assert got == list(cases.values())


def test_metric_limits(spark):
    bodies = {
        "linear": "int a() {\n  return 1;\n}",
        "branchy": "int b() {\n" + "if (x) { if (y && z) { } }\n" * 2 + "for (;;) { }\n}",
        "many": "int c() {\n" + "  if (x) { }\n" * 15 + "}",
        "long": "int d() {\n" + "  step();\n" * 58 + "}",
        "words": 'int e() {\n  log("if for while"); // case catch\n  /* && || */ c = \'"\'; ifs(x);\n}',
    }
    rows = [(k, 1, v.count("\n") + 1, v) for k, v in bodies.items()]
    df = spark.createDataFrame(rows, "name string, start_line bigint, end_line bigint, body string")
    got = {r.name: (r.loc, r.cyclomatic, r.high_complexity) for r in method_metrics(df).collect()}
    assert got == {
        "linear": (3, 1, False), "branchy": (5, 8, False), "many": (17, 16, True), "long": (60, 1, True),
        "words": (4, 1, False),
    }
    strict = {r.name for r in method_metrics(df, 7, 100).filter("high_complexity").collect()}
    assert strict == {"branchy", "many"}


def test_lines_end_at_carriage_returns_too(spark):
    text = "class X {\n  void a() {\n  }\n  void b() { }\n}\n"
    found = [
        [(m["name"], m["start_line"], m["end_line"]) for m in extract.method_table(parse(spark, t)).orderBy("method_ord").collect()]
        for t in (text, text.replace("\n", "\r"), text.replace("\n", "\r\n"))
    ]
    assert found[0] == found[1] == found[2] == [("a", 2, 3), ("b", 4, 4)]


def test_nesting_has_no_silent_end(spark):
    deep = lambda n, a, b, core: a * n + core + b * n
    generics = "class A { void a(" + deep(10, "M<", ">", "X") + " x) { } void b() { } boolean c = 1 < 2 || f(3 > 2); }"
    arguments = "class B { @P" + deep(5, "(a", ")", "1") + " void a() { } }"
    too_deep = "class C { @P" + deep(20, "(a", ")", "1") + " void a() { } void b() { } }"
    p = parse(spark, generics, arguments, too_deep)
    assert sorted(m.signature for m in extract.method_table(p).collect()) == ["void a()", "void a(M x)", "void b()"]
    (error,) = extract.file_errors(p).collect()
    assert error.file_ord == 2 and error.error.endswith("annotation nested too deep")


def test_orders_that_would_collide_are_refused(spark):
    rows = [("r", 5 + (8 << 33), "A.java", "class A { }")]
    table = spark.createDataFrame(rows, "repo string, file_ord bigint, file_path string, source string")
    with pytest.raises(Exception, match="file_ord has to be"):
        extract.type_table(extract.parse_files(table)).collect()


def test_files_are_numbered_in_selection_order(spark):
    paths = [(r, f"{root}{k}/F{i}.java") for r in "ab" for root in ("src/test/java/", "lib/", "src/main/java/") for k in "yx" for i in (2, 1)]
    table = spark.createDataFrame(paths, "repo string, file_path string").repartition(7)
    rank = lambda p: 0 if p.startswith("src/main") else 1 if p.startswith("src/test") else 2
    found = sorted((r.file_ord, r.repo, r.file_path) for r in corpus.number_sources(table).collect())
    assert found == [(i, r, p) for i, (r, p) in enumerate(sorted(paths, key=lambda x: (x[0], rank(x[1]), x[1].split("/"))))]
    assert corpus.number_sources(table.limit(0)).count() == 0
