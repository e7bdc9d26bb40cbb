"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from firegrid.session import build_session  # noqa: E402

HEADLINE = (
    "s11_quality_filter", "g9_dense_cube", "n1_median_windows", "n3_gaussian", "n9_components_4",
    "t8_separability", "d2_residual_multiband", "d5_hourly_score", "d7_assimilated_series",
    "d10b_risk_mask_no_refinement", "d12b_combined_persistence", "d17b_event_detector", "d20_calibration",
    "m1_features", "m9b_local_outlier_factor", "e5_radius_curve", "e6_cell_confusion", "f5_fusion_weighted",
    "y3_days_by_month", "m9a_isolation_forest", "m9e_lof_on_embeddings", "d13_precision_preset", "m5b_boosted_three_rounds",
    "m13b_held_out_three_rounds", "e11_comparison_matrix",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["g7_bin_mean"](spark, sf_dir).count()  # warm the session, not a headline query
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
