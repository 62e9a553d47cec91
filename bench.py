"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ledgerloom.plans import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "parse_numeric",
    "fx_normalize",
    "portfolio_analytics_all",
    "submission_rollup",
    "sector_checklist",
    "dup_count",
    "post_load_audit",
    "contract_audit",
    "fidelity_report",
    "latest_version",
    "dedup_by_hash",
    "merge_chunks",
    "explode_kpis",
    "detect_company",
    "apply_kpi_edits",
    "rag_context_topk",
    "anomaly_vs_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):  # one warm-up run, then the timed run
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
