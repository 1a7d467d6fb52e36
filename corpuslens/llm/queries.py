"""Registered queries of the operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, exact_dedup, negatives, phrases, language, licenses, ngram_lm, packing, pii, quality, sharding, simhash, toxicity
from corpuslens.llm.common import remainder_of_id

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_replaced"), *map(of, pii.KINDS))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(_table(spark, sf_dir, "documents"), remainder_of_id(F.col("doc_id"), 5) != 1)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    automata = language.learn(docs, remainder_of_id(F.col("doc_id"), 4) != 2)
    found = language.identified(docs, automata)
    return found.select("doc_id", (remainder_of_id(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return sharding.with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(docs, _table(spark, sf_dir, "labels"), remainder_of_id(F.col("doc_id"), 5) != 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity_model(docs, spark, sf_dir))
    return found.select(
        "doc_id", (remainder_of_id(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_pii, op3_quality, op4_simhash, op5_language_model, op6_language, op7_sharding, op8_packing, op9_toxicity, op10_licenses, op11_phrases,
        op12_negatives, op13_exact_dedup,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH item AS (SELECT item_id, {_TEXT_WORDS.format('text')} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS words, least(len(w), 13) AS n
    FROM item, LATERAL unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0
),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_TEXT_WORDS.format('text')} AS w FROM documents),
place AS (
    SELECT r, s, n, list_slice(w, s, s + n - 1) AS words
    FROM doc, (SELECT DISTINCT n FROM win) AS sizes, LATERAL unnest(range(1, len(w) - n + 2)) AS t(s)
),
hit AS (SELECT r, s, place.n AS n, item_id FROM place JOIN win ON place.words = win.words),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, s, n FROM hit), LATERAL unnest(range(s, s + n)) AS t(k) GROUP BY r),
listed AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN listed USING (r)""",
    "op3_quality": rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_SPACE_WORDS.format('text')} AS w FROM documents),
gram AS (SELECT r, s, list_slice(w, s, s + 7) AS g FROM doc, LATERAL unnest(range(1, len(w) - 6)) AS x(s)),
twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS n FROM gram) WHERE n > 1),
again AS (SELECT r, count(DISTINCT k) AS n FROM twice, LATERAL unnest(range(s, s + 8)) AS x(k) GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM doc),
lines AS (SELECT r, sum(n) AS n, sum(n - 1) AS dup FROM (SELECT r, l, count(*) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l) GROUP BY r),
most AS (SELECT r, max(n) AS n FROM (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM doc) GROUP BY r, word) GROUP BY r),
facts AS (
    SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(most.n, 0) AS n_most,
           len(list_filter(w, lambda x: len(regexp_extract_all(x, '[A-Z]')) > 1 AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted,
           len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered
    FROM doc LEFT JOIN lines USING (r) LEFT JOIN again USING (r) LEFT JOIN most USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_shouted > 3 * n_words OR 10 * n_lettered < 7 * n_words OR 10 * n_most > 3 * n_words) AS kept
FROM facts""",
    "op13_exact_dedup": r"""
WITH doc AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
ranked AS (
    SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS n,
           row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS k
    FROM doc
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM ranked""",
    "op11_phrases": r"""
WITH doc AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM doc),
word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM word GROUP BY lang),
gram AS (
    SELECT lang, list_slice(w, s, s + m - 1) AS ph
    FROM word, (SELECT unnest([1, 2, 3, 4]) AS m) AS sizes, LATERAL unnest(range(1, len(w) - m + 2)) AS x(s)
),
freq AS (SELECT lang, ph, count(*) AS f FROM gram GROUP BY lang, ph),
cand AS (SELECT lang, ph, f AS a FROM freq WHERE len(ph) >= 2 AND f >= 30),
cut AS (SELECT lang, ph, a, k, list_slice(ph, 1, k) AS lp, list_slice(ph, k + 1, len(ph)) AS rp FROM cand, LATERAL unnest(range(1, len(ph))) AS x(k)),
scored AS (
    SELECT cut.lang, cut.ph, cut.a, k, fl.f AS l, fr.f AS r, CAST((2000000 * CAST(cut.a AS HUGEINT)) // (fl.f + fr.f) AS BIGINT) AS score
    FROM cut JOIN freq AS fl ON fl.lang = cut.lang AND fl.ph = cut.lp JOIN freq AS fr ON fr.lang = cut.lang AND fr.ph = cut.rp
),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM scored) WHERE o = 1),
kept AS (
    SELECT * FROM weakest AS c WHERE NOT EXISTS (
        SELECT 1 FROM cand AS y WHERE y.lang = c.lang AND len(y.ph) > len(c.ph) AND 100 * y.a >= 80 * c.a
          AND (list_slice(y.ph, 1, len(c.ph)) = c.ph OR list_slice(y.ph, 2, len(c.ph) + 1) = c.ph OR list_slice(y.ph, 3, len(c.ph) + 2) = c.ph)
    )
),
ranked AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM kept),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT top.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(total.n AS BIGINT) AS n, score
FROM top JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_negatives": r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
    SELECT a.vec_id AS anchor_id, a.label AS al, v.vec_id, v.label,
           CAST(list_sum(list_transform(range(1, greatest(len(a.e), len(v.e)) + 1), lambda i: coalesce(a.e[i], 0) * coalesce(v.e[i], 0))) AS BIGINT) AS s
    FROM v AS a JOIN v ON a.vec_id IS DISTINCT FROM v.vec_id OR a.label <> v.label OR a.e <> v.e
    WHERE a.vec_id % 100 = 0
),
pos AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id NULLS LAST) AS k FROM pair WHERE label = al) WHERE k <= 5
),
neg AS (
    SELECT pos.anchor_id, pos.vec_id AS positive_id, pos.s AS positive_score, pair.vec_id AS negative_id, pair.s AS negative_score,
           row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY pair.s DESC, pair.vec_id NULLS LAST) AS rank
    FROM pos JOIN pair ON pair.anchor_id = pos.anchor_id AND pair.label <> pos.al
    WHERE 30 * pos.s <= 100 * pair.s AND 100 * pair.s <= 90 * pos.s
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10""",
}
