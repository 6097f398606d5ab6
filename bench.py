"""Times the headline queries and prints one JSON line.

Every query runs over the whole tables of ``$BENCH_SF_DIR``; its result is written
to Spark's no-op sink, so no rows are collected. A short round on the same tables
comes first, because the first queries of a session pay for class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "v4_issue_list",
    "v5_validity_rate",
    "v7_null_rates",
    "f1_numeric_stats",
    "f1_numeric_stats_lines",
    "f2_percentiles_lines",
    "g2_category_counts",
    "d5_mmd_score",
    "d12_ks_statistic",
    "d14_psi",
    "d16_chi2_statistic",
    "d18_null_rate_drift",
    "d20_drift_report",
    "d22_feature_scores",
    "a12_metrics",
    "a10_dispatch",
    "m7_auc",
    "m9_model_report",
    "b1_register",
    "s4_windowed_stream",
    "j2_label_stream_join",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("v4_issue_list", "d5_mmd_score"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
