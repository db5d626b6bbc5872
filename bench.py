"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from stormglass.plans import all_queries
from stormglass.session import local_session

HEADLINE = (
    "s0_macro_obs", "c1_monthly_table", "c2_features", "c3_stress_index", "c5_full_feature_table",
    "c5_customer_targets", "w5_fill_with_max_age", "w13_islands", "p14_trailing_5y",
    "j3_c8_country_year_panel", "a5_t2_coverage", "a7_column_profile", "a8_correlations",
    "a8_correlations_by_sums", "a16_roc_auc", "a17_average_precision", "m17_threshold_sweep",
    "x1_prefix_sum_in_ranges", "x2_order_positions", "w14_chronological_split", "a19_medians",
    "a20_scaled_rows", "m22_attribution", "c10_history_document", "m2_logistic_l2",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(app="stormglass-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    # One untimed run, so that the first query does not carry the start of the JVM.
    queries["c3_stress_index"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
