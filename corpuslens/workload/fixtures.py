"""Source-like tables derived from the given tables.

The given tables hold no program text and no commit log. These formulas derive both
from them, row by row, so the derived corpus grows with the tables. They are written
in SQL that Spark and DuckDB read alike (no backslashes, no '$' followed by a brace).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.durable import growing
from corpuslens.operators.reuse import content_key

K = "CAST(p_partkey AS STRING)"
ROLE_DIRS = (
    "controller", "service", "repository", "entity", "dto", "mapper", "assembler", "config", "exception", "util",
)


def _line(*parts: str) -> str:
    return " || ".join([*parts, "chr(10)"])


def _t(text: str) -> str:
    """Literal in which <k> stands for the part key."""
    pieces = text.split("<k>")
    return "(" + f" || {K} || ".join("'" + piece.replace("'", "''") + "'" for piece in pieces) + ")"


def _ln(text: str) -> str:
    return "(" + _line(_t(text)) + ")"


def _if(condition: str, then: str, otherwise: str = "''") -> str:
    return f"(CASE WHEN {condition} THEN {then} ELSE {otherwise} END)"


ROLE = "(CASE p_partkey % 10 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(ROLE_DIRS)
) + " END)"

FILE_PATH = (
    "('src/' || CASE WHEN p_partkey % 13 = 0 THEN 'test' ELSE 'main' END || '/java/com/acme/services/'"
    f" || lower(p_type) || '/' || {ROLE} || '/C' || {K} || '.java')"
)

IMPORT_A = "CAST(CAST(floor(p_partkey * 3 / 7) AS BIGINT) AS STRING)"
IMPORT_B = "CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)"
IMPORT_HUB = "CAST(p_partkey % 10 AS STRING)"
IMPORT_STATIC = "CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)"

SOURCE = " || ".join(
    [
        "('package com.acme.services.' || lower(p_type) || '.' || " + ROLE + " || ';' || chr(10) || chr(10))",
        _ln("import java.util.List;"),
        f"('import com.acme.C' || {IMPORT_A} || ';' || chr(10))",
        f"('import com.acme.C' || {IMPORT_B} || ';' || chr(10))",
        f"('import com.acme.C' || {IMPORT_HUB} || ';' || chr(10))",
        _if("p_partkey % 12 = 0", f"('import static com.acme.C' || {IMPORT_STATIC} || '.*;' || chr(10))"),
        _ln(""),
        _if("p_partkey % 9 <> 4", _ln("/**") + " || " + _ln(" * Doc of item <k>.") + " || " + _ln(" */")),
        _if("p_partkey % 20 = 0", _ln("@RestController") + " || " + _ln('@RequestMapping("/c<k>")')),
        _if("p_partkey % 20 = 10", _ln('@RequestMapping(value = "/c<k>/", produces = "json")')),
        _if("p_partkey % 10 = 1", _ln("@Service")),
        _if("p_partkey % 30 = 9", _ln("@Configuration")),
        _ln("public class C<k> {"),
        _if(
            "p_partkey % 7 = 0",
            _if(
                "p_partkey % 21 = 0",
                "('    private String apiToken = \"$' || '{TOKEN}\";' || chr(10))",
                _ln('    private String apiToken = "k<k>";'),
            ),
        ),
        _if("p_partkey % 4 = 0", _ln('    static final String NOTE = "if for { while"; // if (x) { case')),
        _ln(""),
        _ln("    public C<k>(Map<String, List<Integer>> m, int... n) {"),
        _ln("        this.m = m;"),
        _ln("    }"),
        _ln(""),
        _ln("    /** Runs a of <k>. */"),
        _if("p_partkey % 20 = 0", _ln('    @GetMapping("/{id}")')),
        _if("p_partkey % 20 = 10", _ln('    @PostMapping(path = "{id}", consumes = "json")')),
        _ln('    public List<String> methodA(@PathVariable("id") final Long id, String[] names) {'),
        f"repeat({_ln('        if (a && b) { c(); }')}, CAST(p_size % 15 AS INT))",
        _if("p_partkey % 5 = 0", _ln('        String sql = "SELECT * FROM t WHERE id = " + id;')),
        _ln("        return null;"),
        _ln("    }"),
        _ln(""),
        _ln("    void methodB() {"),
        f"repeat({_ln('        step(1);')}, CAST(p_size AS INT))",
        _if(
            "p_partkey % 11 = 0",
            _ln("        try { run(); } catch (Exception e) { // ignored") + " || " + _ln("        }"),
        ),
        _if("p_partkey % 11 = 1", _ln("        try { run(); } catch (Exception e) { log(e); }")),
        _ln("    }"),
        _if(
            "p_partkey % 3 = 0",
            _ln("    static class Inner<k> {") + " || " + _ln("        int get() { return 1; }") + " || " + _ln("    }"),
        ),
        _if("p_partkey % 6 = 0", _ln("    interface Port<k> { void call(String s); }")),
        _if("p_partkey % 8 = 0", _ln("    enum Mode<k> { ON, OFF; }")),
        _if("p_partkey % 50 <> 49", _ln("}")),
    ]
)

FILE_COLUMNS = (
    f"p_brand AS repo, CAST(p_partkey AS BIGINT) AS file_ord, {FILE_PATH} AS file_path, {SOURCE} AS source"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows over all cores, in a few tasks a core, before text is made of them.

    A small table is one Parquet row group, hence one task, while a row becomes
    kilobytes of text; with one task a core the slowest core would hold up all others.
    Landed text files need no such step.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def files(spark: SparkSession, sf_dir: str, one_repo: bool = False) -> DataFrame:
    """files(repo, file_ord, file_path, source) from part; one repo per brand, or one in all."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    repo = F.lit("acme") if one_repo else F.col("p_brand")
    return part.select(
        repo.alias("repo"),
        F.col("p_partkey").cast("bigint").alias("file_ord"),
        F.expr(FILE_PATH).alias("file_path"),
        F.expr(SOURCE).alias("source"),
    )


def part_paths(spark: SparkSession, sf_dir: str, one_repo: bool = False) -> DataFrame:
    repo = F.lit("acme") if one_repo else F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        repo.alias("repo"),
        F.col("p_partkey").cast("bigint").alias("file_ord"),
        F.expr(FILE_PATH).alias("file_path"),
    )


def commits(spark: SparkSession, sf_dir: str, one_repo: bool = False) -> DataFrame:
    """commits(repo, commit_ord, date, file_path) from events: newest first, one file each."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_ord"),
        (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("commit_ord"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
    )
    paths = part_paths(spark, sf_dir, one_repo)
    return events.join(growing(paths), "file_ord").select("repo", "commit_ord", "date", "file_path")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of repos without a main root: URL paths, some below excluded directories."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    tail = F.regexp_replace("url", "^[a-z]+://[^/?#]*/?", "")
    top = F.expr("CASE page_id % 5 WHEN 0 THEN 'build/' WHEN 1 THEN 'lib/target/' WHEN 2 THEN 'services/' ELSE '' END")
    return table(spark, sf_dir, "pages").select(
        host.alias("repo"),
        F.col("page_id").alias("file_ord"),
        F.concat(top, tail, F.lit("/P"), F.col("page_id"), F.lit(".java")).alias("file_path"),
        F.lit("").alias("source"),
    )


def commit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records as a reader yields them: date line, then touched paths and blank lines."""
    k, extra = F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("repo"),
        (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("commit_ord"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd"),
            F.lit("\nsrc/main/java/C"), k, F.lit(".java\n\n  docs/D"), extra, F.lit(".md \n\n"),
        ).alias("record"),
    )


def side_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """README and build files of repos R0, R1, ... from supplier, four files each at most."""
    name = F.expr(
        "CASE s_suppkey % 4 WHEN 0 THEN 'readme.md' WHEN 1 THEN 'README.md' WHEN 2 THEN 'pom.xml' ELSE 'build.gradle' END"
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), F.floor(F.col("s_suppkey") / 4)).alias("repo"),
        name.alias("file_path"),
        F.expr("repeat(concat(s_name, ' '), 300)").alias("source"),
    )


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, doc_id, cache_key): the text is hashed where it is read and goes no further."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(F.col("source").alias("repo"), "doc_id", content_key(F.col("text")).alias("cache_key"))


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response texts from events: plain, stringified at one or two levels, and unusable."""
    method = F.array(F.struct(F.concat(F.lit("void m"), F.col("event_id").cast("string"), F.lit("()")).alias("signature"), F.col("event_type").alias("description")))
    aspects = F.array(F.col("event_type"), F.lit("[x"))
    variant = F.col("event_id") % 6

    def one(methods, notable):
        return F.array(
            F.struct(
                F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("class_name"),
                F.when(variant == 4, F.col("props")).otherwise(F.concat(F.lit("see "), F.col("props"))).alias("description"),
                methods.alias("methods"),
                notable.alias("notable_aspects"),
            )
        )

    plain = F.to_json(F.struct(one(method, aspects).alias("classes")))
    outer = F.to_json(F.struct(F.to_json(one(method, aspects)).alias("classes")))
    inner = F.to_json(F.struct(one(F.to_json(method), aspects).alias("classes")))
    both = F.to_json(F.struct(F.to_json(one(F.to_json(method), F.to_json(aspects))).alias("classes")))
    text = (
        F.when(variant == 0, plain).when(variant == 1, outer).when(variant == 2, inner)
        .when(variant == 3, both).when(variant == 4, outer).otherwise(F.concat(F.lit("oops "), plain))
    )
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"))
    return events.select("event_id", text.alias("response"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, lines as fragments in a total order (line numbers repeat)."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(*LINE_ORDER).alias("frag_ord"),
        F.concat(F.lit("part "), "l_partkey").alias("description"),
        F.array(F.struct(F.concat(F.lit("m"), "l_suppkey").alias("signature"), F.col("l_returnflag").alias("description"))).alias("methods"),
        F.array("l_returnflag", "l_linestatus", "l_returnflag").alias("notable_aspects"),
    )


def plain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("R"), F.col("p_partkey") % 25).alias("repo"),
        F.col("p_partkey").alias("type_ord"),
        F.concat(F.lit("C"), "p_partkey").alias("class_name"),
        F.lower("p_type").alias("class_type"),
    )


def conversation_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per conversation: tokens by text length, model by id (one unknown, some without usage)."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "role", F.floor(F.length("text") / 4).alias("tokens")
    )
    spoken = F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(
        F.sum(F.when(~spoken, F.col("tokens"))).alias("input_tokens"),
        F.coalesce(F.sum(F.when(spoken, F.col("tokens"))), F.lit(0)).alias("output_tokens"),
    ).withColumn("model", F.expr("CASE conv_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'unlisted' END"))


ASPECT_WORDS = (
    "JWT check", "Exception path", "HATEOAS links", "Redis backed", "JPA entity", "SLF4J calls", "null guard",
    "builder style", "@Bean method", "Lombok getters", "plain",
)


def aspect_text(k):
    words = F.array(*[F.lit(w) for w in ASPECT_WORDS])
    first = F.get(words, (k % 11).cast("int"))
    second = F.get(words, (k % 7).cast("int"))
    return F.concat_ws(";", first, second)


def part_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ASPECT_WORDS])
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("repo"),
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(" "), F.get(words, (F.col("p_partkey") % 11).cast("int"))).alias("aspect"),
    )


def line_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as routes of their order; the order value is the line's whole sort key."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("orders").alias("repo"),
        F.col("l_orderkey").alias("type_ord"),
        F.struct(*LINE_ORDER).alias("endpoint_ord"),
        F.when(F.col("l_linestatus") == "O", "GET").otherwise("POST").alias("http_method"),
        F.concat(F.lit("/p"), "l_partkey", F.lit("/"), "l_returnflag").alias("path"),
    )
