"""Registered queries against their SQL counterparts on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from corpuslens.workload import oracles, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# One of each kind; the whole list is compared by the driver of the repository.
NAMES = (
    "corpus_capped", "corpus_order", "lenient_decode", "commit_touches", "excerpt_first", "cache_upsert", "masked_source", "method_decls",
    "annotations", "doc_comment", "rest_routes", "findings_all", "match_lines", "dep_fan_in", "hotspots", "render_prompt",
    "greedy_batches", "oversized_split", "cache_stats", "enrich_batches", "json_repair", "fragment_merge", "overview_input",
    "analysis_doc", "endpoint_preview",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return sorted(plain, key=str)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = entry_points.queries()[name](spark, FOLDER)
    cursor = sql.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_a_counterpart():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
