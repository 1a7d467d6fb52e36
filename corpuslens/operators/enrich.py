"""Batch enrichment with a caller-supplied function, and merging its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.durable import let

BATCH_KEYS = ["repo", "dir", "batch_ord", "part"]

# USD per million tokens (input, output) by tier, and for unknown models.
TIER_PRICES = {"small": (1.00, 5.00), "medium": (3.00, 15.00), "large": (5.00, 25.00)}
DEFAULT_PRICE = (1.00, 5.00)

CLASS_STRUCT = (
    "struct<class_name:string,description:string,"
    "methods:array<struct<signature:string,description:string>>,notable_aspects:array<string>>"
)


def enrich_batches(
    prompts: DataFrame, call: Callable[[str], tuple[str, int, int]], keys: list[str] | None = None
) -> DataFrame:
    """One call per row: prompt to (response text, input tokens, output tokens).

    A failed call becomes an ``error`` text; the other rows go on. Calls are at least
    once, so wrap the result in ``durable`` before using it more than once.
    """
    keys = BATCH_KEYS if keys is None else keys
    types = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*keys).schema
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for prompt in frame["prompt"]:
                try:
                    answers.append((*call(prompt), None))
                except Exception as exc:  # contained per row by design
                    answers.append((None, None, None, f"call failed: {exc}"))
            columns = ["response", "input_tokens", "output_tokens", "error"]
            added = pd.DataFrame(answers, columns=columns, index=frame.index).astype(
                {"input_tokens": "Int64", "output_tokens": "Int64"}
            )
            yield pd.concat([frame[keys], added], axis=1)

    return prompts.select(*keys, "prompt").mapInPandas(
        run, f"{types}, response string, input_tokens bigint, output_tokens bigint, error string"
    )


# --- response texts ----------------------------------------------------------


def _list_field(json: Column, name: str) -> Column:
    """struct<items, repaired>: a list field's elements as texts, also if it was stringified."""
    native = F.from_json(json, f"struct<{name}:array<string>>")[name]
    text = F.get_json_object(json, f"$.{name}")
    return F.struct(
        F.coalesce(native, F.from_json(text, "array<string>")).alias("items"),
        (native.isNull() & text.isNotNull()).alias("repaired"),
        text.isNotNull().alias("present"),
    )


def _is_container(text: Column) -> Column:
    """Text that is itself a JSON list or object."""
    lead = F.substring(F.ltrim(text), 1, 1)
    return F.coalesce(
        ((lead == "[") & F.json_array_length(text).isNotNull())
        | ((lead == "{") & F.json_object_keys(text).isNotNull()),
        F.lit(False),
    )


RESPONSE = f"struct<classes:array<{CLASS_STRUCT}>>"


def parse_response(response: Column) -> Column:
    """struct<classes, repaired, valid> of a response text.

    A complete, well-formed response is read in one go. Only otherwise is the text taken
    apart field by field, see :func:`_repair`.
    """

    def complete(classes: Column) -> Column:
        return classes.isNotNull() & F.forall(
            classes,
            lambda c: c["class_name"].isNotNull()
            & c["description"].isNotNull()
            & c["methods"].isNotNull()
            & F.forall(c["methods"], lambda m: m["signature"].isNotNull() & m["description"].isNotNull())
            & c["notable_aspects"].isNotNull()
            & F.forall(c["notable_aspects"], lambda a: a.isNotNull()),
        )

    return let(
        F.from_json(response, RESPONSE)["classes"],
        lambda classes: F.when(
            F.coalesce(complete(classes), F.lit(False)),
            F.struct(
                classes.alias("classes"), F.lit(False).alias("repaired"), F.lit(True).alias("valid")
            ),
        ).otherwise(_repair(response)),
    )


def _repair(response: Column) -> Column:
    """struct<classes, repaired, valid>, read field by field.

    A list field whose value is a JSON text is decoded, at each level. Plain text fields
    stay as they are; but where decoding was needed, a text field that is itself a JSON
    list or object decodes to something that is no text, and the response is invalid.
    """

    def method_of(json: Column) -> Column:
        return F.struct(
            F.get_json_object(json, "$.signature").alias("signature"),
            F.get_json_object(json, "$.description").alias("description"),
        )

    def class_of(json: Column) -> Column:
        def build(methods: Column, aspects: Column) -> Column:
            return F.struct(
                F.get_json_object(json, "$.class_name").alias("class_name"),
                F.get_json_object(json, "$.description").alias("description"),
                F.transform(methods["items"], method_of).alias("methods"),
                aspects["items"].alias("notable_aspects"),
                (methods["repaired"] | aspects["repaired"]).alias("repaired"),
                (
                    (~methods["present"] | methods["items"].isNotNull())
                    & (~aspects["present"] | aspects["items"].isNotNull())
                ).alias("lists_ok"),
            )

        return let(
            _list_field(json, "methods"),
            lambda m: let(_list_field(json, "notable_aspects"), lambda a: build(m, a)),
        )

    def judge(listed: Column) -> Column:
        def texts(c: Column) -> Column:
            return F.concat(
                F.array(c["class_name"], c["description"]),
                F.coalesce(F.flatten(F.transform(c["methods"], lambda m: F.array(m["signature"], m["description"]))), F.array().cast("array<string>")),
                F.coalesce(c["notable_aspects"], F.array().cast("array<string>")),
            )

        def whole(classes: Column) -> Column:
            repaired = listed["repaired"] | F.exists(classes, lambda c: c["repaired"])
            complete = F.forall(
                classes, lambda c: c["lists_ok"] & F.forall(texts(c), lambda t: t.isNotNull())
            )
            plain = ~repaired | F.forall(
                classes, lambda c: F.forall(texts(c), lambda t: ~_is_container(t))
            )
            return F.struct(
                F.transform(
                    classes,
                    lambda c: F.struct(
                        c["class_name"].alias("class_name"),
                        c["description"].alias("description"),
                        F.coalesce(
                            c["methods"],
                            F.expr("cast(array() as array<struct<signature:string,description:string>>)"),
                        ).alias("methods"),
                        F.coalesce(c["notable_aspects"], F.array().cast("array<string>")).alias(
                            "notable_aspects"
                        ),
                    ),
                ).alias("classes"),
                repaired.alias("repaired"),
                F.coalesce(complete & plain, F.lit(False)).alias("valid"),
            )

        return let(F.transform(listed["items"], class_of), whole)

    return let(_list_field(response, "classes"), judge)


def parse_responses(enriched: DataFrame) -> DataFrame:
    """Adds ``classes``, ``repaired``; an unusable response becomes an ``error``."""
    parsed = enriched.withColumn("_p", parse_response(F.col("response")))
    usable = F.col("error").isNull() & F.coalesce(F.col("_p.valid"), F.lit(False))
    return (
        parsed.withColumn("classes", F.when(usable, F.col("_p.classes")))
        .withColumn("repaired", usable & F.coalesce(F.col("_p.repaired"), F.lit(False)))
        .withColumn(
            "error",
            F.coalesce("error", F.when(~usable, F.lit("response failed schema validation"))),
        )
        .drop("_p")
    )


# --- matching and merging ----------------------------------------------------


def match_back(parsed: DataFrame, members: DataFrame) -> DataFrame:
    """Answers joined to the batch's members by name; the last member of a name wins.

    Names that are not in the batch find no partner and fall out.
    """
    last = members.groupBy(*BATCH_KEYS, "class_name").agg(
        F.max("type_ord").alias("type_ord"),
        F.max_by("file_path", "type_ord").alias("file_path"),
    )
    answers = (
        parsed.filter(F.col("classes").isNotNull())
        .select(*BATCH_KEYS, F.posexplode("classes").alias("pos", "c"))
        .select(*BATCH_KEYS, "pos", "c.*")
    )
    return answers.join(last, [*BATCH_KEYS, "class_name"]).select(
        "repo",
        "type_ord",
        "file_path",
        "class_name",
        # a type lies in one batch, or in the parts of its own one
        (F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("pos")).alias("frag_ord"),
        "description",
        "methods",
        "notable_aspects",
    )


def merge_fragments(
    fragments: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, methods, aspects) of fragments(keys…, frag_ord, description, methods, notable_aspects).

    Kept flat, so no list is ever rebuilt per key: the description is that of the first
    fragment, methods keep (frag_ord, pos), aspects are distinct per record in first-seen
    order. A record that came as one fragment is left as it came, repeats included.
    """
    records = fragments.groupBy(*keys).agg(
        F.min_by("description", "frag_ord").alias("description"),
        F.count("*").alias("fragments"),
    )
    methods = fragments.select(
        *keys, "frag_ord", F.posexplode("methods").alias("pos", "m")
    ).select(*keys, "frag_ord", "pos", "m.signature", "m.description")
    aspects = (
        fragments.select(*keys, "frag_ord", F.posexplode("notable_aspects").alias("pos", "aspect"))
        .withColumn("seen", F.struct("frag_ord", "pos"))
        .join(records.select(*keys, "fragments"), keys)
        .withColumn("copy", F.when(F.col("fragments") == 1, F.col("pos")).otherwise(-1))
        .groupBy(*keys, "aspect", "copy")
        .agg(F.min("seen").alias("seen"))
        .drop("copy")
    )
    return records, methods, aspects


def last_method_texts(methods: DataFrame, keys: list[str]) -> DataFrame:
    """One description per signature; the last one given wins."""
    return methods.groupBy(*keys, "signature").agg(
        F.max_by("description", F.struct("frag_ord", "pos")).alias("description")
    )


# --- overview ----------------------------------------------------------------

NONE_FOUND = "(none found)"


def overview_input(
    repos: DataFrame,
    readme: DataFrame,
    build: DataFrame,
    types: DataFrame,
    descriptions: DataFrame,
    chunk: Column,
) -> DataFrame:
    """(repo, part, text): part -1 is the head, then the described types' lines in order.

    The whole input of a repo is the head followed by its parts joined by a newline. It
    is kept in parts because a repo's list of types has no bound; ``chunk`` is a
    non-decreasing function of type_ord that holds a bounded number of types.
    """
    head = (
        repos.select("repo")
        .join(readme.select("repo", F.col("excerpt").alias("_r")), "repo", "left")
        .join(build.select("repo", F.col("excerpt").alias("_b")), "repo", "left")
        .select(
            "repo",
            F.lit(-1).cast("bigint").alias("part"),
            F.concat(
                F.lit("README:\n"),
                F.when(F.coalesce("_r", F.lit("")) != "", F.col("_r")).otherwise(NONE_FOUND),
                F.lit("\n\nBuild file (dependencies):\n"),
                F.when(F.coalesce("_b", F.lit("")) != "", F.col("_b")).otherwise(NONE_FOUND),
                F.lit("\n\nClass purposes:\n"),
            ).alias("text"),
        )
    )
    lines = (
        types.select("repo", "type_ord", "class_name", "class_type")
        .join(descriptions.select("repo", "type_ord", "description"), ["repo", "type_ord"])
        .select(
            "repo",
            "type_ord",
            chunk.cast("bigint").alias("part"),
            F.concat(
                F.lit("- "), "class_name", F.lit(" ("), "class_type", F.lit("): "), "description"
            ).alias("line"),
        )
        .groupBy("repo", "part")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.struct("type_ord", "line"))).getField("line"), "\n"
            ).alias("text")
        )
    )
    return head.unionByName(lines)


FALLBACK_TEXT = "Overview generation failed -- see run logs for details."  # fixed value


def with_overview(repos: DataFrame, overviews: DataFrame) -> DataFrame:
    """Overview row of each repo; the fixed fallback where there is none."""
    found = overviews.withColumn("_found", F.lit(True))
    none = F.array().cast("array<string>")
    missing = F.col("_found").isNull()
    return repos.select("repo").join(found, "repo", "left").select(
        "repo",
        F.when(missing, F.col("repo")).otherwise(F.col("name")).alias("name"),
        F.when(missing, F.lit(FALLBACK_TEXT)).otherwise(F.col("description")).alias("description"),
        F.coalesce("tech_stack", none).alias("tech_stack"),
        F.when(missing, F.lit("")).otherwise(F.col("architecture_summary")).alias("architecture_summary"),
        F.coalesce("main_modules", none).alias("main_modules"),
    )


# --- usage -------------------------------------------------------------------


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tokens; a call that reported no usage is not counted."""
    return (
        usage.filter(F.col("input_tokens").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("calls_made"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
    )


def usage_cost(totals: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``cost_usd``; ``prices`` maps a model to USD per million tokens (in, out)."""
    pairs = [
        F.lit(item)
        for model, (price_in, price_out) in prices.items()
        for item in (model, [float(price_in), float(price_out)])
    ]
    default = F.array(*[F.lit(p) for p in DEFAULT_PRICE])
    price = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), default) if pairs else default
    return totals.withColumn(
        "cost_usd",
        F.col("input_tokens") / 1_000_000 * price[0] + F.col("output_tokens") / 1_000_000 * price[1],
    )
