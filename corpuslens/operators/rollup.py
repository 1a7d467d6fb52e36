"""Roll-ups behind a report: modules, categories, rankings, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.durable import growing
from corpuslens.operators.scans import SEVERITIES


def module_key(path: Column) -> Column:
    """Segment after the first 'services'; else the parent directory; else 'root'."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "services").cast("int")
    parent = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("root")
    return F.when(at > 0, F.coalesce(F.get(parts, at), F.lit("root"))).otherwise(parent)


def module_groups(types: DataFrame) -> DataFrame:
    return types.groupBy("repo", module_key(F.col("file_path")).alias("module")).agg(
        F.count("*").alias("types")
    )


# Categories in order of precedence with the keywords that select them.
ASPECT_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        "Security & Authentication",
        ("security", "jwt", "authentic", "authoriz", "@secured", "@preauthorize", "credential", "token", "userdetails"),
    ),
    (
        "Error Handling",
        ("exception", "error handling", "@controlleradvice", "@exceptionhandler", "catch-all"),
    ),
    (
        "REST API & Hypermedia",
        (
            "hateoas", "hypermedia", "@relation", "responseentity", "representationmodel", "hal-formatted",
            "collection relation", "item relation",
        ),
    ),
    ("Caching & Performance", ("cache", "redis", "ttl", "pagination", "performance")),
    (
        "Persistence & Data Access",
        (
            "jpa", "repository", "querydsl", "query", "persistence", "criteria api", "sql", "hibernate", "@idclass",
            "primary key", "@transactional",
        ),
    ),
    ("Logging & Observability", ("log", "slf4j", "mdc", "diagnostic context", "audit")),
    ("Validation & Null-Safety", ("null", "valid", "empty string")),
    (
        "Design Patterns & Mapping",
        (
            "pattern", "mapper", "mapstruct", "convert", "builder", "singleton", "factory", "delegat", "adapter",
            "decorator", "utility class", "cannot be instantiated",
        ),
    ),
    (
        "Configuration & Dependency Injection",
        (
            "@bean", "@configuration", "@enable", "dependency injection", "@requiredargsconstructor",
            "@postconstruct", "constructor-based", "@componentscan", "@service", "@component", "spring-managed",
        ),
    ),
    (
        "Code Complexity & Structure",
        ("cyclomatic", "complexity", "boilerplate", "lombok", "overload", "@fieldnameconstants"),
    ),
)
OTHER_ASPECT = "Other"


def aspect_category(text: Column) -> Column:
    """First category one of whose keywords occurs in the lower-cased text."""
    lowered = F.lower(text)
    category = F.lit(None).cast("string")
    for label, words in reversed(ASPECT_RULES):
        hit = reduce(Column.__or__, [F.contains(lowered, F.lit(word)) for word in words])
        category = F.when(hit, F.lit(label)).otherwise(category)
    return F.coalesce(category, F.lit(OTHER_ASPECT))


def aspect_rollup(aspects: DataFrame, order: list[str]) -> DataFrame:
    """Category sizes with the place of the first aspect seen, which breaks ties of size."""
    return (
        aspects.groupBy("repo", aspect_category(F.col("aspect")).alias("category"))
        .agg(F.count("*").alias("aspects"), F.min(F.struct(*order)).alias("first_seen"))
    )


def finding_text(message: Column, line: Column) -> Column:
    located = F.concat(message, F.lit(" (line "), line.cast("string"), F.lit(")"))
    return F.when(F.coalesce(line, F.lit(0)) != 0, located).otherwise(message)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Count per severity (high, medium, low); absent ones do not appear."""
    return findings.groupBy(
        "repo", "severity", severity_rank(F.col("severity")).alias("severity_rank")
    ).agg(F.count("*").alias("findings"))


def complex_methods(methods: DataFrame) -> DataFrame:
    return methods.filter("high_complexity").select(
        "repo",
        "type_ord",
        "method_ord",
        F.concat(
            F.lit("High-complexity method "),
            "signature",
            F.lit(" (cyclomatic~="),
            "cyclomatic",
            F.lit(", loc="),
            "loc",
            F.lit(")"),
        ).alias("text"),
    )


def _last_by_name(types: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Of the types carrying one of few names, the last of each name."""
    return (
        types.select("repo", "class_name", "type_ord", *columns)
        .join(names.select("repo", "class_name").distinct(), ["repo", "class_name"], "left_semi")
        .groupBy("repo", "class_name")
        .agg(*[F.max_by(c, "type_ord").alias(c) for c in columns])
    )


def hotspot_detail(ranked: DataFrame, types: DataFrame, churn: DataFrame) -> DataFrame:
    """Text of each ranked name, taken from the last type that carries it."""
    names = ranked.select("repo", "rank", "class_name")
    chosen = _last_by_name(types, names, "file_path", "heavy_methods")
    return (
        names.join(chosen, ["repo", "class_name"])
        .join(growing(churn), ["repo", "file_path"])
        .select(
            "repo",
            "rank",
            "class_name",
            "file_path",
            F.concat(
                F.col("commit_count").cast("string"),
                F.lit(" commit(s) · last modified "),
                F.coalesce("last_modified", F.lit("unknown")),
                F.lit(" · "),
                F.col("heavy_methods").cast("string"),
                F.lit(" high-complexity method(s)"),
            ).alias("text"),
        )
    )


def relied_upon_detail(fan_in: DataFrame, types: DataFrame) -> DataFrame:
    chosen = _last_by_name(types, fan_in, "file_path")
    return fan_in.join(chosen, ["repo", "class_name"], "left").select(
        "repo",
        "rank",
        "class_name",
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.concat(
            F.lit("Depended on by "),
            F.col("fan_in").cast("string"),
            F.when(F.col("fan_in") == 1, " other class").otherwise(" other classes"),
        ).alias("text"),
    )


# Report categories in order.
CATEGORIES = (
    "Security Findings",
    "Hotspots — changed often, hard to change safely",
    "Most Relied-Upon Classes",
    "High-Complexity Methods",
    "Notable Aspects",
)


def findings_overview(
    types: DataFrame,
    findings: DataFrame,
    hotspot_rows: DataFrame,
    relied_upon: DataFrame,
    heavy: DataFrame,
    aspects: DataFrame,
) -> DataFrame:
    """All report findings as rows, in report order by category_rank, group_rank, type_ord, item_ord.

    Columns: repo, category_rank, category, group_rank, subcategory, type_ord, item_ord,
    class_name, file_path, text. Empty categories have no rows. Severities come high to
    low, aspect categories largest first; rankings have their rank as item_ord.
    ``aspects`` has columns repo, type_ord, seen, aspect.
    """
    names = types.select("repo", "type_ord", "class_name", "file_path")
    zero, none = F.lit(0).cast("bigint"), F.lit("")

    def rows(
        df: DataFrame, rank: int, item: Column, group: Column = zero, subcategory: Column = none, type_ord: Column = zero
    ) -> DataFrame:
        return df.select(
            "repo",
            F.lit(rank).cast("bigint").alias("category_rank"),
            F.lit(CATEGORIES[rank]).alias("category"),
            group.cast("bigint").alias("group_rank"),
            subcategory.alias("subcategory"),
            type_ord.alias("type_ord"),
            item.cast("bigint").alias("item_ord"),
            "class_name",
            "file_path",
            "text",
        )

    own = F.col("type_ord")
    security = findings.select(
        "repo",
        "type_ord",
        "finding_ord",
        "severity",
        finding_text(F.col("message"), F.col("line")).alias("text"),
    ).join(growing(names), ["repo", "type_ord"])
    in_type = Window.partitionBy("repo", "type_ord").orderBy("seen")
    labelled = aspects.withColumn("category", aspect_category(F.col("aspect"))).withColumn(
        "item_ord", F.row_number().over(in_type) - 1
    )
    by_size = Window.partitionBy("repo").orderBy(F.desc("aspects"), "first_seen")
    ranks = aspect_rollup(aspects, ["type_ord", "seen"]).select(
        "repo", "category", F.row_number().over(by_size).alias("group_rank")
    )
    notable = (
        labelled.join(ranks, ["repo", "category"])
        .join(growing(names), ["repo", "type_ord"])
        .withColumn("text", F.col("aspect"))
    )
    return (
        rows(security, 0, F.col("finding_ord"), severity_rank(F.col("severity")), F.initcap("severity"), own)
        .unionByName(rows(hotspot_rows, 1, F.col("rank")))
        .unionByName(rows(relied_upon, 2, F.col("rank")))
        .unionByName(rows(heavy.join(growing(names), ["repo", "type_ord"]), 3, F.col("method_ord"), type_ord=own))
        .unionByName(rows(notable, 4, F.col("item_ord"), F.col("group_rank"), F.col("category"), own))
    )


def hit_rate_pct(made: Column, cached: Column) -> Column:
    """Share of cached in all, in percent with one decimal (half to even); 0.0 without calls."""
    total = made + cached
    return F.when(total > 0, F.bround(F.lit(100) * cached / total, 1)).otherwise(F.lit(0.0))


def dashboard_totals(metadata: DataFrame, types: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Totals per repo; each input is aggregated before the joins."""
    zero = F.lit(0).cast("bigint")
    type_counts = types.groupBy("repo").agg(
        F.count("*").alias("_types"),
        F.sum("n_methods").alias("_methods"),
        F.sum("heavy_methods").alias("_heavy"),
    )
    endpoint_counts = endpoints.groupBy("repo").agg(F.count("*").alias("_endpoints"))
    return (
        metadata.join(type_counts, "repo", "left")
        .join(endpoint_counts, "repo", "left")
        .select(
            "repo",
            F.coalesce("_types", zero).alias("types"),
            F.coalesce("_methods", zero).alias("methods"),
            F.coalesce("_endpoints", zero).alias("endpoints"),
            F.coalesce("_heavy", zero).alias("high_complexity"),
            F.col("security_findings_total").alias("findings"),
            hit_rate_pct(F.col("calls_made"), F.col("calls_cached")).alias("hit_rate_pct"),
        )
    )


def generated_at_text(iso: Column) -> Column:
    """'2026-01-01T02:00:00+02:00' to 'January 01, 2026 at 12:00 AM UTC', in any session zone."""
    at_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp_ntz(F.to_timestamp(iso).cast("string")))
    return F.date_format(at_utc, "MMMM dd, yyyy 'at' hh:mm a 'UTC'")


def endpoint_preview(
    types: DataFrame, methods: DataFrame, endpoints: DataFrame, aspects: DataFrame, shown: int = 4
) -> DataFrame:
    """Card texts of each type: its first routes, '+n more', 'n methods · n notable'."""
    key = ["repo", "type_ord"]
    first = Window.partitionBy(*key).orderBy("endpoint_ord")
    routes = (
        endpoints.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= shown)
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("_n", F.concat_ws(" ", "http_method", "path").alias("route")))
            )
            .getField("route")
            .alias("_routes")
        )
    )
    totals = endpoints.groupBy(*key).agg(F.count("*").alias("_endpoints"))
    method_counts = methods.groupBy(*key).agg(F.count("*").alias("_methods"))
    aspect_counts = aspects.groupBy(*key).agg(F.count("*").alias("_aspects"))
    extra = F.col("_endpoints") - shown
    count = F.coalesce("_methods", F.lit(0))
    return (
        types.select(*key, "class_name")
        .join(routes, key, "left")
        .join(totals, key, "left")
        .join(method_counts, key, "left")
        .join(aspect_counts, key, "left")
        .select(
            *key,
            "class_name",
            F.coalesce(F.array_join("_routes", ", "), F.lit("")).alias("routes"),
            F.when(extra > 0, F.concat(F.lit("+"), extra, F.lit(" more"))).otherwise("").alias("more"),
            F.concat(
                count.cast("string"),
                F.when(count == 1, " method").otherwise(" methods"),
                F.when(
                    F.coalesce("_aspects", F.lit(0)) > 0, F.concat(F.lit(" · "), "_aspects", F.lit(" notable"))
                ).otherwise(""),
            ).alias("footer"),
        )
    )


def job_summary(metadata: DataFrame) -> DataFrame:
    """Metric/value rows of each repo."""
    rows = [
        ("Files parsed", F.col("total_files_parsed").cast("string")),
        ("Parse errors", F.col("parse_errors").cast("string")),
        ("LLM calls made", F.col("calls_made").cast("string")),
        ("Served from cache", F.col("calls_cached").cast("string")),
        ("Tokens (in / out)", F.concat_ws(" / ", "total_input_tokens", "total_output_tokens")),
        ("Estimated cost", F.format_string("$%.4f", "estimated_cost_usd")),
    ]
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows])
    return metadata.select("repo", F.posexplode(listed).alias("metric_ord", "r")).select(
        "repo", "metric_ord", "r.*"
    )
