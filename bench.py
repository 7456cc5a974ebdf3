"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from rolecall.plans.catalogue import QUERIES
from rolecall.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "classify_documents", "category_summary", "tag_summary", "monthly_rollup",
    "match_all_keywords", "match_specs", "limit_per_spec", "search_cycle",
    "dedup_exact", "new_only", "dedup_with_expiry", "seen_store_stats",
    "take_while", "upsert_orders", "extract_pages", "extract_list_cards", "extract_link_cards",
    "list_cycle",
)


def seconds(query, spark) -> float:
    """Building, planning and running a query, with all its rows made."""
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        # The better of two runs: the first one also loads classes and starts workers.
        times[name] = round(min(seconds(QUERIES[name], spark) for _ in range(2)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
