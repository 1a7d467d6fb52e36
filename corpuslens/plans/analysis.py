"""A whole run: source files and commit log to analysed types, rankings and document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.durable import durable
from corpuslens.functions.text import token_estimate
from corpuslens.operators import assemble, batching, churn as churn_ops, enrich, extract, graph, reuse, rollup
from corpuslens.sources import corpus, results

KEY = ["repo", "type_ord"]
OVERVIEW = (
    "repo string, name string, description string, tech_stack array<string>, "
    "architecture_summary string, main_modules array<string>"
)


@dataclass(frozen=True)
class Options:
    model: str = "small"
    prices: tuple[tuple[str, tuple[float, float]], ...] = tuple(enrich.TIER_PRICES.items())
    prompt_version: str = reuse.PROMPT_VERSION
    token_ceiling: int = batching.TOKEN_CEILING
    batch_size: int = batching.BATCH_SIZE
    files_per_part: int = 500
    cyclomatic_limit: int = extract.CYCLOMATIC_LIMIT
    loc_limit: int = extract.LOC_LIMIT


@dataclass(frozen=True)
class Analysis:
    """Tables of a finished plan; nothing is written."""

    errors: DataFrame
    types: DataFrame
    methods: DataFrame
    endpoints: DataFrame
    findings: DataFrame
    edges: DataFrame
    churn: DataFrame
    hotspots: DataFrame
    batches: DataFrame
    responses: DataFrame
    store: DataFrame
    overview_input: DataFrame
    metadata: DataFrame
    assembled: DataFrame
    document: DataFrame
    report: DataFrame


def _type_chunk(options: Options) -> Column:
    return F.floor(F.shiftright(F.col("type_ord"), extract.ORD_BITS) / options.files_per_part)


def _stored_fragments(hits: DataFrame) -> DataFrame:
    return hits.select(
        *KEY, F.lit(0).cast("bigint").alias("frag_ord"), "description", "methods", "notable_aspects"
    )


def _admitted(fragments: DataFrame, keyed: DataFrame) -> DataFrame:
    """Store entries of types that came back as one fragment; of equal keys the last wins."""
    single = fragments.join(reuse.admissible(fragments, KEY), KEY, "left_semi")
    entry = F.struct("class_name", "description", "methods", "notable_aspects")
    return (
        single.select(*KEY, entry.alias("entry"))
        .join(keyed.select(*KEY, "cache_key"), KEY)
        .groupBy("cache_key")
        .agg(F.max_by("entry", F.struct("repo", "type_ord")).alias("entry"))
        .select("cache_key", "entry.*")
    )


def analyze(
    files: DataFrame,
    commits: DataFrame,
    store: DataFrame,
    call: Callable[[str], tuple[str, int, int]],
    side_files: DataFrame | None = None,
    overviews: DataFrame | None = None,
    options: Options = Options(),
) -> Analysis:
    """Plan a run over files(repo, file_ord, file_path, source) and commits.

    ``store`` holds earlier results; types whose rendered text is known there are not sent
    to ``call``. ``side_files`` are README and build files (same columns, no file_ord),
    ``overviews`` the overview rows written from ``overview_input``, if there are any.

    Work is cut from its lineage where several readers follow: texts are read once
    (``facts``), types rendered once (``keyed``), batches packed once (``members``), calls
    made once (``answers``) and matched once (``fragments``). All are far smaller than the
    texts.
    """
    spark = files.sparkSession
    facts = durable(
        extract.parse_files(
            files,
            docs=True,
            metrics=True,
            findings=True,
            cyclomatic_limit=options.cyclomatic_limit,
            loc_limit=options.loc_limit,
        )
    )
    types = extract.type_table(facts)
    methods = extract.method_table(facts)
    endpoints = extract.route_table(facts)
    findings = extract.finding_table(facts)
    errors = extract.file_errors(facts)
    edges = graph.dependency_edges(types, extract.import_table(facts))
    depends_on = graph.depends_on_lists(edges)
    churn = churn_ops.churn_by_file(commits)

    rendered = batching.render_types(types, methods)
    keyed = durable(
        rendered.withColumn("cache_key", reuse.content_key(F.col("text"), options.prompt_version))
    )
    hits, misses = reuse.split_by_store(keyed, store)
    members = durable(
        batching.build_batches(
            misses.drop("cache_key"), options.token_ceiling, options.batch_size, token_estimate
        )
    )
    prompts = batching.batch_prompts(members)
    answers = durable(enrich.enrich_batches(prompts, call))
    responses = enrich.parse_responses(answers)
    fragments = durable(enrich.match_back(responses, members))
    records, method_texts, aspects = enrich.merge_fragments(
        fragments.select(*KEY, "frag_ord", "description", "methods", "notable_aspects").unionByName(
            _stored_fragments(hits)
        ),
        KEY,
    )
    new_store = results.upsert_results(store, _admitted(fragments, keyed))

    repos = files.select("repo").distinct()
    if side_files is None:
        side_files = spark.createDataFrame([], "repo string, file_path string, source string")
    overview_input = enrich.overview_input(
        repos,
        corpus.first_excerpt(side_files, corpus.README_CANDIDATES, corpus.README_LIMIT),
        corpus.first_excerpt(side_files, corpus.BUILD_CANDIDATES, corpus.BUILD_LIMIT),
        types,
        records,
        _type_chunk(options),
    )
    overview = enrich.with_overview(
        repos, spark.createDataFrame([], OVERVIEW) if overviews is None else overviews
    )

    totals = enrich.usage_totals(answers, ["repo"]).withColumn("model", F.lit(options.model))
    metadata = assemble.run_metadata(
        files,
        errors,
        enrich.usage_cost(totals, dict(options.prices)),
        reuse.store_stats(keyed, store),
        findings,
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"),
        options.model,
    )
    assembled = assemble.assemble_types(
        types,
        assemble.assemble_methods(methods, methods, enrich.last_method_texts(method_texts, KEY)),
        endpoints,
        findings,
        aspects,
        records,
        depends_on,
        churn,
    )
    hotspots = churn_ops.hotspots(types, churn)
    document = assemble.document_parts(
        overview, metadata, errors, assembled, depends_on, hotspots, _type_chunk(options)
    )
    report = rollup.findings_overview(
        types,
        findings,
        rollup.hotspot_detail(hotspots, types, churn),
        rollup.relied_upon_detail(graph.fan_in(types, edges), types),
        rollup.complex_methods(methods),
        aspects,
    )
    return Analysis(
        errors=errors,
        types=types,
        methods=methods,
        endpoints=endpoints,
        findings=findings,
        edges=edges,
        churn=churn,
        hotspots=hotspots,
        batches=members,
        responses=responses,
        store=new_store,
        overview_input=overview_input,
        metadata=metadata,
        assembled=assembled,
        document=document,
        report=report,
    )


__all__ = ["Analysis", "Options", "analyze"]
