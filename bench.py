"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is run
to the end into a sink that keeps nothing. Each runs twice in one session; the
second, warm time is reported, the first under ``first_run``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.session import build_session
from queries.registry import QUERIES

HEADLINE = [
    "migration_plan", "latest_n_versions", "install_script", "select_sources", "ledger_latest", "fail_fast_prefix",
    "ledger_apply", "current_database", "statement_report", "key_violations", "orphans", "row_difference",
    "evolve_orders", "schema_diff", "duplicate_definitions", "column_rules", "mask_secrets", "verify_report",
    "lint_report", "existing_columns", "replay_facts", "ledger_stream", "user_step",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    first = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    warm = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
