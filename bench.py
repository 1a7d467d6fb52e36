"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma
separated names, or 'all'). Each query runs to the end into a sink that keeps nothing;
persisted frames are dropped between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslens.workload.queries import QUERIES  # noqa: E402
from corpuslens.workload.session import local_session  # noqa: E402

HEADLINE = (
    "type_decls", "method_decls", "method_cyclomatic", "scan_secrets", "findings_all", "match_lines", "dep_edges",
    "dep_fan_in", "churn_by_file", "hotspots", "render_prompt", "greedy_batches", "oversized_split", "batch_prompts",
    "cache_hits", "cache_misses", "enrich_batches", "json_repair", "enrich_match", "fragment_merge",
    "assemble_types", "analysis_doc", "findings_overview", "aspect_category", "endpoint_preview", "html_safe_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's machinery
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
