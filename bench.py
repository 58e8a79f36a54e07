"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ordersight.plans.catalog import QUERIES
from ordersight.session import local_session

HEADLINE = [
    "noise_removed", "cleaning_report", "determinant_availability", "product_history_0", "asof_product_x",
    "asof_seller_x", "historic_transporter_x", "historic_seller_x", "feature_matrix_0", "feature_matrix_5",
    "feature_matrix_all_days", "temporal_split", "class_weights", "route_by_threshold", "cat_thresholds",
    "carry_over", "daily_report", "dynamic_hcot"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    seconds = {}
    QUERIES["noise_by_rule"](spark, folder).collect()  # start the JVM's engine before measuring
    for name in HEADLINE:
        start = time.perf_counter()
        # Every column of every row is computed; nothing is pulled to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
