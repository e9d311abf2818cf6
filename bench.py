"""Headline queries of the search engine, timed: prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Building
the index is a figure of its own; every query is timed once, to its last row.
``batch_qps`` is the rate of queries that are evaluated as one plan.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quern.plans import registry, search  # noqa: E402
from quern.plans.parser import Page, parse  # noqa: E402

NAMES = [
    "search_single_term", "search_and", "search_must_not", "search_phrase", "search_phrase3_loose", "search_filter_range", "search_highlight", "search_weighted_fields_and",
    "multi_query_batch", "idf_table", "doc_lengths", "segment_live_docs", "segment_search", "snippets", "stream_ingest_search",
]
BATCH = 200


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    timed("index_build_documents", lambda: registry.index(spark, folder))
    timed("index_build_parts", lambda: registry.index(spark, folder, registry.PARTS))
    for name in NAMES:
        timed(name, lambda name=name: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
    index = registry.index(spark, folder)
    words = [r["term"] for r in index.postings.groupBy("term").count().orderBy("count", ascending=False).limit(BATCH + 1).collect()]
    batch = [parse(f"{a} {b}") for a, b in zip(words, words[1:])]
    timed("batch_200_queries", lambda: search.ranked_each(search.hits(index, batch), Page()).write.format("noop").mode("overwrite").save())
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "batch_qps": round(len(batch) / took["batch_200_queries"], 1), "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
