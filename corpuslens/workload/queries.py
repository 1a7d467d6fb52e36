"""Registered queries: every operator on tables derived from the given ones."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.durable import computed_once, durable, growing
from corpuslens.operators import (
    assemble,
    batching,
    churn as churn_ops,
    enrich,
    extract,
    graph,
    reuse,
    rollup,
    scans,
)
from corpuslens.sources import commits as commit_source
from corpuslens.sources import corpus, results
from corpuslens.workload import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def type_chunk(files_per_chunk: int = 500) -> Column:
    return F.floor(F.shiftright(F.col("type_ord"), extract.ORD_BITS) / files_per_chunk)


# --- shared inputs -----------------------------------------------------------


def parsed(spark: SparkSession, d: str, one_repo: bool = False, **parts: bool) -> DataFrame:
    return extract.parse_files(X.files(spark, d, one_repo), **parts)


def measured(spark: SparkSession, d: str) -> DataFrame:
    return extract.method_table(parsed(spark, d, metrics=True))


def type_findings(spark: SparkSession, d: str) -> DataFrame:
    return extract.finding_table(parsed(spark, d, findings=True))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents")


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "source", "text")


# --- sources and sinks -------------------------------------------------------


@query
def corpus_select(spark: SparkSession, d: str) -> DataFrame:
    paths = X.part_paths(spark, d).withColumn("source", F.lit(""))
    return corpus.select_sources(paths, include_tests=True).select("repo", "file_path")


@query
def corpus_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Whole-tree selection: repos without a main root, excluded directories apart."""
    paths = X.page_paths(spark, d)
    return corpus.select_sources(paths).select("repo", "file_path")


@query
def corpus_capped(spark: SparkSession, d: str) -> DataFrame:
    paths = X.part_paths(spark, d).withColumn("source", F.lit(""))
    chosen = corpus.select_sources(paths, include_tests=True)
    return corpus.cap_sources(chosen, 20).select("repo", "file_path")


@query
def corpus_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every file among all files."""
    return corpus.number_sources(X.part_paths(spark, d))


@query
def lenient_decode(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of every document with one bad byte put in front."""
    docs = documents(spark, d).select("doc_id", "text")
    raw = docs.select(
        "doc_id", F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8")).alias("content")
    )
    decoded = raw.withColumn("source", T.decode_lenient(F.col("content")))
    return decoded.select(
        "doc_id",
        F.length("source").cast("bigint").alias("chars"),
        F.md5(F.col("source").cast("binary")).alias("digest"),
    )


@query
def commit_touches(spark: SparkSession, d: str) -> DataFrame:
    return commit_source.commit_touches(X.commit_records(spark, d))


@query
def commit_reanchor(spark: SparkSession, d: str) -> DataFrame:
    pages = X.table(spark, d, "pages").select(
        F.lit("web").alias("repo"),
        F.col("page_id").alias("commit_ord"),
        F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("file_path"),
    )
    return commit_source.reanchor(pages, "en")


@query
def excerpt_first(spark: SparkSession, d: str) -> DataFrame:
    side = X.side_files(spark, d)
    readme = corpus.first_excerpt(side, corpus.README_CANDIDATES, corpus.README_LIMIT)
    build = corpus.first_excerpt(side, corpus.BUILD_CANDIDATES, corpus.BUILD_LIMIT)
    return readme.withColumn("kind", F.lit("readme")).unionByName(
        build.withColumn("kind", F.lit("build"))
    )


@query
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    keyed = X.keyed_documents(spark, d)

    def entries(rows: DataFrame, label: str) -> DataFrame:
        return rows.groupBy("cache_key").agg(
            F.concat(F.lit(label), F.min("doc_id")).alias("description")
        )

    old = entries(keyed.filter("doc_id % 3 <> 1"), "old ")  # a third is old, a third new, a third both
    new = entries(keyed.filter("doc_id % 3 <> 0"), "new ")
    return results.upsert_results(old, new)


# --- extraction --------------------------------------------------------------


@query
def masked_source(spark: SparkSession, d: str) -> DataFrame:
    files = X.files(spark, d)
    masked = files.select(
        "repo", "file_path", F.regexp_replace(T.mask_code(F.col("source")), r"\s+", " ").alias("masked")
    )
    return masked.select(
        "repo",
        "file_path",
        F.length("masked").cast("bigint").alias("chars"),
        F.md5(F.col("masked").cast("binary")).alias("digest"),
    )


@query
def type_decls(spark: SparkSession, d: str) -> DataFrame:
    return extract.type_table(parsed(spark, d)).select(
        "repo", "type_ord", "file_path", "package", "class_name", "kind", "start_line", "end_line"
    )


@query
def method_decls(spark: SparkSession, d: str) -> DataFrame:
    return extract.method_table(parsed(spark, d)).select(
        "repo",
        "type_ord",
        "method_ord",
        "class_name",
        "name",
        "signature",
        "return_type",
        F.array_join("parameters", ", ").alias("parameters"),
        F.array_join("modifiers", " ").alias("modifiers"),
        "start_line",
        "end_line",
    )


@query
def imports(spark: SparkSession, d: str) -> DataFrame:
    return extract.import_table(parsed(spark, d)).select("repo", "type_ord", "class_name", "import_path")


def _annotation_rows(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("annotations").alias("pos", "a")).select(
        *keys,
        big("pos"),
        F.col("a.name").alias("name"),
        F.array_join("a.arguments", "|").alias("arguments"),
    )


@query
def annotations(spark: SparkSession, d: str) -> DataFrame:
    p = durable(parsed(spark, d))
    none = F.lit(-1).cast("bigint")
    owners = extract.type_table(p).select("repo", "type_ord", none.alias("method_ord"), "annotations")
    members = extract.method_table(p).select("repo", "type_ord", "method_ord", "annotations")
    return _annotation_rows(owners.unionByName(members), "repo", "type_ord", "method_ord")


@query
def block_end(spark: SparkSession, d: str) -> DataFrame:
    """End line of the block opened by every line that declares a method or type."""
    lines = T.source_lines(F.col("source"))
    listed = X.files(spark, d).select("repo", "file_path", lines.alias("lines"))
    starts = F.filter(
        F.transform(
            "lines", lambda s, i: F.when(F.regexp_like(s, F.lit(r"(?:methodA|methodB|class C\d+|class Inner\d+)\b")), i + 1)
        ),
        lambda n: n.isNotNull(),
    )
    ends = F.transform(
        starts,
        lambda n: F.struct(
            n.cast("bigint").alias("start_line"),
            extract.block_end_line(F.col("lines"), n.cast("bigint")).alias("end_line"),
        ),
    )
    return listed.select("repo", "file_path", F.inline(ends))


@query
def doc_comment(spark: SparkSession, d: str) -> DataFrame:
    p = durable(parsed(spark, d, docs=True))
    none = F.lit(-1).cast("bigint")
    owners = extract.type_table(p).select("repo", "type_ord", none.alias("method_ord"), "javadoc")
    members = extract.method_table(p).select("repo", "type_ord", "method_ord", "javadoc")
    return owners.unionByName(members)


@query
def type_role(spark: SparkSession, d: str) -> DataFrame:
    return extract.type_table(parsed(spark, d)).select("repo", "type_ord", "class_name", "class_type")


@query
def rest_routes(spark: SparkSession, d: str) -> DataFrame:
    return extract.route_table(parsed(spark, d)).select("repo", "type_ord", "class_name", "http_method", "path")


@query
def file_errors(spark: SparkSession, d: str) -> DataFrame:
    return extract.file_errors(parsed(spark, d)).select("repo", "file_ord", "error")


# --- metrics and scans -------------------------------------------------------


@query
def method_loc(spark: SparkSession, d: str) -> DataFrame:
    methods = extract.method_table(parsed(spark, d))
    return methods.select(
        "repo", "type_ord", "method_ord", (F.col("end_line") - F.col("start_line") + 1).alias("loc")
    )


@query
def method_cyclomatic(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).select("repo", "type_ord", "method_ord", "signature", "cyclomatic")


@query
def method_high_complexity(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).select("repo", "type_ord", "method_ord", "high_complexity")


@query
def scan_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Secret rule without the type prefix over whole document texts."""
    docs = document_texts(spark, d).withColumn("start_line", F.lit(1))
    return scans.scan(docs, ("secrets",), text="text", type_prefix="").select(
        "doc_id", "source", "severity", "message", "line"
    )


@query
def scan_sql_concat(spark: SparkSession, d: str) -> DataFrame:
    files = X.files(spark, d).withColumn("start_line", F.lit(1))
    return scans.scan(files, ("sql",), text="source").select("repo", "file_path", "severity", "line")


@query
def scan_empty_catch(spark: SparkSession, d: str) -> DataFrame:
    files = X.files(spark, d).withColumn("start_line", F.lit(1))
    return scans.scan(files, ("catch",), text="source").select("repo", "file_path", "severity", "line")


@query
def match_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all matches of a pattern that spans a line end, in whole document texts."""
    docs = document_texts(spark, d)
    found = docs.select(
        "doc_id", T.matches_with_line(F.col("text"), r"\.\n", F.lit(1)).alias("hits")
    )
    return found.select(
        "doc_id",
        F.size("hits").cast("bigint").alias("matches"),
        F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["line"]).alias("line_sum"),
    )


@query
def findings_all(spark: SparkSession, d: str) -> DataFrame:
    return type_findings(spark, d).select(
        "repo", "type_ord", "class_name", big("finding_ord"), "category", "severity", "message", "line"
    )


@query
def findings_total(spark: SparkSession, d: str) -> DataFrame:
    return scans.findings_total(type_findings(spark, d))


# --- graph, churn ------------------------------------------------------------


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = durable(parsed(spark, d, one_repo=True))
    types = extract.type_table(p)
    return types, graph.dependency_edges(types, extract.import_table(p))


@query
def dep_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


@query
def dep_lists(spark: SparkSession, d: str) -> DataFrame:
    return graph.depends_on_lists(_graph(spark, d)[1]).select(
        "repo", "class_name", F.array_join("depends_on", ",").alias("depends_on")
    )


@query
def dep_fan_in(spark: SparkSession, d: str) -> DataFrame:
    types, edges = _graph(spark, d)
    return graph.fan_in(types, edges).select("repo", "class_name", "fan_in", big("rank"))


@query
def churn_by_file(spark: SparkSession, d: str) -> DataFrame:
    return churn_ops.churn_by_file(X.commits(spark, d))


@query
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Which types change often and are hard to change? One pass over the texts."""
    types = extract.type_table(parsed(spark, d, metrics=True))
    churn = churn_ops.churn_by_file(X.commits(spark, d))
    ranked = churn_ops.hotspots(types, churn)
    return ranked.select("repo", big("rank"), "class_name", "file_path", "commit_count", "heavy_methods", "score")


# --- batching ----------------------------------------------------------------


@query
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = durable(parsed(spark, d, docs=True, metrics=True))
    rendered = batching.render_types(extract.type_table(p), extract.method_table(p))
    return rendered.select("repo", "type_ord", "text")


@query
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        "doc_id", T.token_estimate(F.length("text")).cast("bigint").alias("tokens")
    )


def _document_items(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        F.lit("docs").alias("repo"),
        F.col("source").alias("dir"),
        F.col("doc_id").alias("ord"),
        T.token_estimate(F.length("text")).alias("cost"),
    )


@query
def batch_groups(spark: SparkSession, d: str) -> DataFrame:
    return (
        X.part_paths(spark, d)
        .groupBy("repo", T.directory_of(F.col("file_path")).alias("dir"))
        .agg(F.count("*").alias("files"), F.min("file_ord").alias("first_file"))
    )


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return batching.greedy_batches(
        _document_items(spark, d), ["repo", "dir"], chunk=F.floor(F.col("ord") / 100)
    )


@query
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(
        "repo", "dir", F.col("ord").alias("doc_id"), "batch_ord", "batch_no", "oversized"
    )


@query
def oversized_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents over 500 tokens, split at lines (a line stands for a method)."""
    docs = document_texts(spark, d).select(
        "doc_id",
        F.lit("doc {").alias("head"),
        F.transform(F.split("text", "\n", -1), lambda s: F.concat(F.lit("\n"), s)).alias("pieces"),
        F.concat(F.lit("doc {\n"), "text", F.lit("\n}")).alias("text"),
    )
    parts = batching.split_oversized(docs, ceiling=500)
    return parts.select(
        "doc_id", big("part"), "first_piece", "n_pieces", F.length("part_text").cast("bigint").alias("chars")
    )


@query
def batch_prompts(spark: SparkSession, d: str) -> DataFrame:
    members = (
        _packed(spark, d)
        .filter(~F.col("oversized"))
        .join(documents(spark, d).select(F.col("doc_id").alias("ord"), "text"), "ord")
        .select(
            "repo", "dir", "batch_ord", F.lit(0).alias("part"), F.col("ord").alias("type_ord"),
            F.col("text").alias("member_text"),
        )
    )
    return batching.batch_prompts(members).select(
        "dir",
        "batch_ord",
        "members",
        F.length("prompt").cast("bigint").alias("chars"),
        F.md5(F.col("prompt").cast("binary")).alias("digest"),
    )


# --- result reuse ------------------------------------------------------------


@query
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return X.keyed_documents(spark, d).select("doc_id", "cache_key")


def _store(spark: SparkSession, d: str) -> DataFrame:
    return (
        X.keyed_documents(spark, d)
        .filter("doc_id % 3 = 0")
        .groupBy("cache_key")
        .agg(F.concat(F.lit("D"), F.min("doc_id")).alias("class_name"))
    )


@query
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = reuse.split_by_store(X.keyed_documents(spark, d), _store(spark, d))
    return hits.select("doc_id", "cache_key", "stored_name")


@query
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    _, misses = reuse.split_by_store(X.keyed_documents(spark, d), _store(spark, d))
    return misses.select("doc_id", "cache_key")


@query
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return reuse.store_stats(X.keyed_documents(spark, d), _store(spark, d))


@query
def cache_admit(spark: SparkSession, d: str) -> DataFrame:
    fragments = X.table(spark, d, "lineitem").select("l_orderkey")
    return reuse.admissible(fragments, ["l_orderkey"])


# --- enrichment --------------------------------------------------------------


def describe_text(prompt: str) -> tuple[str, int, int]:
    """Pure stand-in for a text service, with failures that depend on the length only."""
    size = len(prompt)
    if size % 7 == 0:
        raise ValueError("service unavailable")
    if size % 5 == 0:
        return "no json", size // 4, 2
    classes = [{"class_name": f"T{size % 4}", "description": f"{size} characters"}]
    answer = {"classes": json.dumps(classes) if size % 3 == 0 else classes}
    return json.dumps(answer), size // 4, 10


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    prompts = document_texts(spark, d).withColumnRenamed("text", "prompt")
    return enrich.parse_responses(enrich.enrich_batches(prompts, describe_text, ["doc_id", "source"]))


@query
def enrich_batches(spark: SparkSession, d: str) -> DataFrame:
    answered = _enriched(spark, d)
    return answered.select(
        "doc_id",
        "input_tokens",
        "output_tokens",
        "repaired",
        F.get("classes", F.lit(0))["description"].alias("description"),
    )


@query
def enrich_failures(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).filter("error is not null").select("doc_id", "error")


@query
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    responses = X.event_responses(spark, d)
    parsed_events = computed_once(responses, p=enrich.parse_response(F.col("response")))
    first = F.get("p.classes", F.lit(0))
    return parsed_events.select(
        "event_id",
        F.col("p.valid").alias("valid"),
        F.when(F.col("p.valid"), F.col("p.repaired")).alias("repaired"),
        F.when(F.col("p.valid"), first["description"]).alias("description"),
        F.when(F.col("p.valid"), F.array_join(F.transform(first["methods"], lambda m: m["signature"]), "|")).alias("methods"),
        F.when(F.col("p.valid"), F.array_join(first["notable_aspects"], "|")).alias("aspects"),
    )


def _named_batches(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter(~F.col("oversized")).select(
        "repo",
        "dir",
        "batch_ord",
        F.lit(0).alias("part"),
        F.col("ord").alias("type_ord"),
        F.concat("dir", F.lit("/"), F.col("ord")).alias("file_path"),
        F.concat(F.lit("T"), F.col("ord") % 4).alias("class_name"),
    )


@query
def enrich_match(spark: SparkSession, d: str) -> DataFrame:
    """Each batch is answered for names T0, T1, T2 and for one nobody asked about."""
    members = _named_batches(spark, d)
    names = F.array(*[F.lit(n) for n in ("T0", "T1", "T2", "Unknown")])
    classes = F.transform(
        names,
        lambda n: F.struct(
            n.alias("class_name"),
            F.concat(n, F.lit(" of "), "batch_ord").alias("description"),
            F.expr("cast(array() as array<struct<signature:string,description:string>>)").alias("methods"),
            F.array().cast("array<string>").alias("notable_aspects"),
        ),
    )
    answers = members.select(*enrich.BATCH_KEYS).distinct().withColumn("classes", classes)
    return enrich.match_back(answers, members).select(
        "type_ord", "file_path", "class_name", "description", F.col("frag_ord").alias("pos")
    )


@query
def fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    records, methods, aspects = enrich.merge_fragments(X.line_fragments(spark, d), ["l_orderkey"])
    first_seen = aspects.groupBy("l_orderkey").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("seen", "aspect"))).getField("aspect"), ","
        ).alias("aspects")
    )
    counts = methods.groupBy("l_orderkey").agg(F.count("*").alias("methods"))
    return records.join(first_seen, "l_orderkey").join(counts, "l_orderkey")


@query
def overview_input(spark: SparkSession, d: str) -> DataFrame:
    side = X.side_files(spark, d)
    types = X.plain_types(spark, d)
    parts = enrich.overview_input(
        types.select("repo").distinct(),
        corpus.first_excerpt(side, corpus.README_CANDIDATES, corpus.README_LIMIT),
        corpus.first_excerpt(side, corpus.BUILD_CANDIDATES, corpus.BUILD_LIMIT),
        types,
        types.filter("type_ord % 3 <> 0").select(
            "repo", "type_ord", F.concat(F.lit("about "), "type_ord").alias("description")
        ),
        F.floor(F.col("type_ord") / 1000),
    )
    return parts.select(
        "repo", "part", F.length("text").cast("bigint").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest")
    )


@query
def overview_fallback(spark: SparkSession, d: str) -> DataFrame:
    customers = X.table(spark, d, "customer").select(F.col("c_name").alias("repo"), "c_custkey", "c_mktsegment")
    found = customers.filter("c_custkey % 2 = 0").select(
        "repo",
        F.concat(F.lit("P"), "c_custkey").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.array("c_mktsegment", F.lit("java")).alias("tech_stack"),
        F.lit("layers").alias("architecture_summary"),
        F.array(F.lit("core")).alias("main_modules"),
    )
    return enrich.with_overview(customers, found).select(
        "repo",
        "name",
        "description",
        F.array_join("tech_stack", ",").alias("tech_stack"),
        "architecture_summary",
        F.array_join("main_modules", ",").alias("main_modules"),
    )


@query
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return enrich.usage_totals(X.conversation_usage(spark, d), ["model"])


@query
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    totals = enrich.usage_totals(X.conversation_usage(spark, d), ["model"])
    return enrich.usage_cost(totals, enrich.TIER_PRICES).select(
        "model", F.round("cost_usd", 6).alias("cost_usd")
    )


# --- assembly ----------------------------------------------------------------


class Run:
    """Tables of one analysis run over the derived corpus."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.files = X.files(spark, d)
        p = durable(extract.parse_files(self.files, docs=True, metrics=True, findings=True))
        self.errors = extract.file_errors(p)
        self.types = extract.type_table(p)
        self.methods = extract.method_table(p)
        self.endpoints = extract.route_table(p)
        self.findings = extract.finding_table(p)
        self.edges = graph.dependency_edges(self.types, extract.import_table(p))
        self.churn = churn_ops.churn_by_file(X.commits(spark, d))
        described = self.types.filter("type_ord % 4 <> 1")
        self.records = described.select(
            "repo", "type_ord", F.concat(F.lit("Purpose of "), "class_name").alias("description")
        )
        self.aspects = described.select(
            "repo",
            "type_ord",
            F.posexplode(F.split(X.aspect_text(F.shiftright("type_ord", extract.ORD_BITS)), ";")).alias("seen", "aspect"),
        )
        self.method_texts = self.methods.filter("method_ord <> 1").select(
            "repo", "type_ord", "signature", F.concat(F.lit("Does "), "name").alias("description")
        )
        self.lookups = self.types.groupBy("repo").agg(
            F.count_if(F.col("type_ord") % 4 == 0).alias("hits"),
            F.count_if(F.col("type_ord") % 4 != 0).alias("misses"),
        )
        self.usage = enrich.usage_cost(
            self.types.groupBy("repo").agg(
                F.count("*").alias("calls_made"),
                F.sum("start_line").alias("input_tokens"),
                F.sum("end_line").alias("output_tokens"),
            ).withColumn("model", F.lit("small")),
            enrich.TIER_PRICES,
        )

    def metadata(self) -> DataFrame:
        return assemble.run_metadata(
            self.files, self.errors, self.usage, self.lookups, self.findings, F.lit("2026-01-01T00:00:00+00:00"), "small"
        )

    def assembled_methods(self) -> DataFrame:
        measured_only = self.methods.filter("method_ord <> 2")
        return assemble.assemble_methods(self.methods, measured_only, self.method_texts)

    def assembled_types(self) -> DataFrame:
        return assemble.assemble_types(
            self.types,
            self.assembled_methods(),
            self.endpoints,
            self.findings,
            self.aspects,
            self.records,
            graph.depends_on_lists(self.edges),
            self.churn,
        )

    def hotspots(self) -> DataFrame:
        return churn_ops.hotspots(self.types, self.churn)


@query
def assemble_methods(spark: SparkSession, d: str) -> DataFrame:
    return Run(spark, d).assembled_methods()


@query
def assemble_types(spark: SparkSession, d: str) -> DataFrame:
    types = Run(spark, d).assembled_types()
    return types.select(
        "repo",
        "type_ord",
        "class_name",
        "class_type",
        "description",
        F.size("methods").cast("bigint").alias("methods"),
        F.array_join(F.transform("rest_endpoints", lambda e: F.concat_ws(" ", e["http_method"], e["path"])), ",").alias("routes"),
        F.array_join("notable_aspects", ";").alias("aspects"),
        F.array_join(F.transform("security_findings", lambda f: f["category"]), ",").alias("findings"),
        F.array_join("depends_on", ",").alias("depends_on"),
        F.col("churn.commit_count").alias("commit_count"),
        F.col("churn.last_modified").alias("last_modified"),
    )


@query
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    return Run(spark, d).metadata().withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 6))


def _document(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    overview = enrich.with_overview(
        run.files.select("repo").distinct(),
        spark.createDataFrame(
            [],
            "repo string, name string, description string, tech_stack array<string>, "
            "architecture_summary string, main_modules array<string>",
        ),
    )
    return assemble.document_parts(
        overview, run.metadata(), run.errors, run.assembled_types(), graph.depends_on_lists(run.edges), run.hotspots(), type_chunk()
    )


@query
def analysis_doc(spark: SparkSession, d: str) -> DataFrame:
    """Document parts; list sections of plain fields are compared by their text."""
    plain = F.col("section").isin("dependency_graph", "hotspots", "parse_errors")
    return _document(spark, d).select(
        "repo", "section", "part", "sub", "items", F.when(plain, F.col("payload")).alias("payload")
    )


@query
def analysis_json(spark: SparkSession, d: str) -> DataFrame:
    """One JSON text per type: facts, churn and history nulls kept."""
    run = Run(spark, d)
    rows = run.types.join(growing(run.churn), ["repo", "file_path"], "left")
    doc = F.to_json(
        F.struct(
            "file_path",
            "package",
            "class_name",
            "class_type",
            F.struct("start_line", "end_line").alias("span"),
            F.when(
                F.col("commit_count").isNotNull(), F.struct("commit_count", "last_modified")
            ).alias("churn"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select("repo", "type_ord", doc.alias("document"))


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    counts = run.types.groupBy("repo").agg(F.count("*").alias("types"))
    return assemble.run_summary(run.metadata(), counts)


# --- report roll-ups ---------------------------------------------------------


@query
def module_groups(spark: SparkSession, d: str) -> DataFrame:
    web = X.page_paths(spark, d).select("repo", "file_path")
    return rollup.module_groups(X.part_paths(spark, d).select("repo", "file_path").unionByName(web))


@query
def aspect_category(spark: SparkSession, d: str) -> DataFrame:
    """Category of every whole document text and of every keyworded part name."""
    docs = document_texts(spark, d).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    parts = X.part_aspects(spark, d).select(F.lit("part").alias("kind"), "id", F.col("aspect").alias("text"))
    return docs.unionByName(parts).select("kind", "id", rollup.aspect_category(F.col("text")).alias("category"))


@query
def aspect_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = rollup.aspect_rollup(X.part_aspects(spark, d), ["id"])
    return rolled.select("repo", "category", "aspects", F.col("first_seen.id").alias("first_seen"))


@query
def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.severity_rollup(type_findings(spark, d)).select(
        "repo", "severity", big("severity_rank"), "findings"
    )


@query
def complex_methods(spark: SparkSession, d: str) -> DataFrame:
    return rollup.complex_methods(measured(spark, d))


@query
def hotspot_detail(spark: SparkSession, d: str) -> DataFrame:
    types = extract.type_table(durable(parsed(spark, d, metrics=True)))
    churn = churn_ops.churn_by_file(X.commits(spark, d))
    ranked = churn_ops.hotspots(types, churn)
    return rollup.hotspot_detail(ranked, types, churn).select(
        "repo", big("rank"), "class_name", "file_path", "text"
    )


@query
def relied_upon_detail(spark: SparkSession, d: str) -> DataFrame:
    types, edges = _graph(spark, d)
    return rollup.relied_upon_detail(graph.fan_in(types, edges), types).select(
        "repo", big("rank"), "class_name", "file_path", "text"
    )


@query
def findings_overview(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return rollup.findings_overview(
        run.types,
        run.findings,
        rollup.hotspot_detail(run.hotspots(), run.types, run.churn),
        rollup.relied_upon_detail(graph.fan_in(run.types, run.edges), run.types),
        rollup.complex_methods(run.methods),
        run.aspects,
    )


@query
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return rollup.dashboard_totals(run.metadata(), run.types, run.endpoints)


@query
def generated_at_text(spark: SparkSession, d: str) -> DataFrame:
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return X.table(spark, d, "events").select(
        "event_id", rollup.generated_at_text(iso).alias("generated_at")
    )


@query
def endpoint_preview(spark: SparkSession, d: str) -> DataFrame:
    """Orders as types, their lines as routes and methods."""
    lines = X.line_routes(spark, d)
    types = X.table(spark, d, "orders").select(
        F.lit("orders").alias("repo"),
        F.col("o_orderkey").alias("type_ord"),
        F.concat(F.lit("O"), "o_orderkey").alias("class_name"),
    )
    aspects = lines.filter("path like '%/R'")
    return rollup.endpoint_preview(types, lines, lines, aspects).select(
        "type_ord", "class_name", "routes", "more", "footer"
    )


@query
def html_safe_text(spark: SparkSession, d: str) -> DataFrame:
    pages = X.table(spark, d, "pages")
    return pages.select("page_id", T.html_safe(F.col("html")).alias("html"))


@query
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    return rollup.job_summary(Run(spark, d).metadata()).select("repo", big("metric_ord"), "metric", "value")
