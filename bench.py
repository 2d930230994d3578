"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line with seconds per query.

Each query is executed in full into Spark's ``noop`` sink (every row is computed, nothing
is collected to the driver). A tiny warm-up job starts the JVM first. As in a deployment,
the clean record table is built once (timed as ``materialize_records``) and the queries
read it; ``BENCH_MATERIALIZE=0`` derives it from the star schema in every query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans.registry import load_all  # noqa: E402
from riskloom.session import get_spark  # noqa: E402

HEADLINE = [
    "class_distribution", "records", "dataset_overview", "describe_numeric", "iqr_outliers",
    "correlation_matrix", "top_crops_by_state", "municipal_profile", "prior_year_mean",
    "prior_row_mean", "drought_index", "climate_left_join", "target_encode", "stratified_folds",
    "label_metrics", "roc_auc", "threshold_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = get_spark(f"local[{cpus}]", parts, app_name="riskloom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    reg = load_all()
    times = {}
    if os.environ.get("BENCH_MATERIALIZE", "1") == "1":
        # Stage handoff: build the clean record table once (timed), then query it.
        from riskloom.sources.tables import materialize_records
        t0 = time.perf_counter()
        materialize_records(spark, sf_dir)
        times["materialize_records"] = round(time.perf_counter() - t0, 3)
    def run_all():
        out = {}
        for name in names:
            t0 = time.perf_counter()
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - t0, 3)
        return out

    times.update(run_all())
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
              "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).replace("sf", ""),
              "cpus": cpus, "shuffle_partitions": parts}
    if os.environ.get("BENCH_WARM") == "1":  # a second pass over the same session (JIT warm)
        warm = run_all()
        result["queries_warm"] = warm
        result["value_warm"] = round(sum(warm.values()), 3)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
