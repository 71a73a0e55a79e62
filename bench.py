"""Headline queries at one scale factor; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "split_summary",
    "join_left_flag",
    "frequency_encoding",
    "entity_stats_apply",
    "vocabulary_apply",
    "velocity",
    "velocity_tied",
    "column_reduction",
    "rule_score",
    "ranking_metrics",
    "recall_at_capacity",
    "reliability_bins",
    "ev_policy_summary",
    "policy_rehearsal",
    "cost_sweep",
    "global_cut_best",
    "column_drift",
    "score_views",
    "bootstrap_paired",
    "bootstrap_metrics",
    "reason_codes",
    "level_capture",
    "stream_scoring",
)


def main() -> None:
    from riskframe.catalog import QUERIES
    from riskframe.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "riskframe-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    # one small query starts the JVM's code paths; it is not timed
    QUERIES["split_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
