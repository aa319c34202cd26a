"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelkit.queries import QUERIES
from panelkit.session import get_spark

HEADLINE = [
    "flagship_within_lag",
    "q1_profile",
    "q4_consistency_check",
    "q5_missing_times",
    "q8_fill_from_group",
    "a1_mean_median",
    "a9_correlation_by_entity",
    "w2_observed_lags",
    "w3_gap_lag",
    "w4_moving_average",
    "w5_lowess",
    "w6_kernel_smooth",
    "w7_rank_slice",
    "m4_glm_poisson_by_entity",
    "m5_ols_by_entity",
    "m6_within",
    "m8_poisson_fe_one",
    "t7_locally_robust_ar1",
    "t11_vcov_arellano",
    "t13_poisson_cluster_two_way",
    "i4_impute_poisson",
    "i13_interval_forecast",
    "i15_scenario_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        f"local[{cpus}]",
        "panelkit-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the session
    times: dict[str, float] = {}
    for key in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()  # the next query starts from the files
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
