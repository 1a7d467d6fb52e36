"""What the parser does once, and what it must still find."""

from pyspark.sql import functions as F

from corpuslens.operators import extract
from corpuslens.operators.metrics import cyclomatic
from corpuslens.workload import fixtures


def parsed(spark, *texts, **kw):
    rows = [("r", i, f"F{i}.java", text) for i, text in enumerate(texts)]
    return extract.parse_files(spark.createDataFrame(rows, "repo string, file_ord long, file_path string, source string"), **kw)


def test_fold_binds_no_state(spark):
    """A bound value is copied: all spans so far at every step, so the square of a file's blocks."""
    assert "transform" not in str(extract._block_spans(F.col("facts")))


def test_branches_are_counted_without_a_masked_copy(spark):
    text = 'if (a && b) { /* if */ x = "while"; } // for\n case \'|\': a || b; & & notif ifx "if'
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    assert "replace" not in str(cyclomatic(F.col("t")))
    assert [r.n for r in rows.select(cyclomatic(F.col("t")).alias("n")).collect()] == [5, 1, None]


def test_texts_are_made_in_several_tasks_a_core(spark):
    made = fixtures.spread(spark.range(10))
    assert made.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in made.collect()) == list(range(10))


def test_doc_gap_counts_characters_whatever_their_bytes(spark):
    def java(between):
        return f"/** é😀 */ {between} class A {{ void m() {{}} }}"

    words = "// " + "é😀" * 90  # 183 characters, 543 bytes
    texts = [
        java(""), java(words + "\n"), java(words + "é" * 17 + "\n"), java(words + "é" * 18 + "\n"), java(" " * 9000 + words + "\n"),
        java("// a" + " " * 9000 + "b\n"), java("//" + "x" * 9000 + "\n"),
    ]
    types = extract.type_table(parsed(spark, *texts, docs=True)).orderBy("type_ord").collect()
    assert [t.javadoc for t in types] == ["é😀", "é😀", "é😀", None, "é😀", None, None]


def test_nested_blocks_and_their_ends(spark):
    deep = "class A {\n void m() {\n" + "if (x) {\n" * 50 + "}\n" * 50 + "}\n class B { int n() { return 1; }\n }\n}\n"
    kept, open_, under = parsed(spark, deep, deep + "class C {", deep + "}", metrics=True).orderBy("file_ord").collect()
    assert (open_.problem, under.problem) == ("block not closed", "closing brace without an opening one")
    assert [(t.class_name, t.start_line, t.end_line) for t in kept.types] == [("A", 1, 106), ("B", 104, 105)]
    assert [(m.name, m.start_line, m.end_line, m.cyclomatic) for t in kept.types for m in t.methods] == [("m", 2, 103, 51), ("n", 104, 105, 1)]  # braces count from the start of the line
