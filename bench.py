"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of source tables, BENCH_CPUS the local cores. Each query is built and
written to a sink that discards rows, BENCH_RUNS times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from quaestor.session import build_session
from quaestor.verification.queries import queries

HEADLINE = (
    "int_customer_policies", "int_customer_claims", "int_customer_interactions",
    "dim_customers", "fact_policies", "mart_competitor_analysis",
    "product_performance", "channel_performance", "interaction_summary", "cluster_summary",
    "multi_claim_customers", "policy_trends", "monthly_claims", "premium_by_product",
    "customer_policy_join", "city_clv",
    "profile_columns", "profile_numeric", "profile_categorical", "profile_overview",
    "hist_income", "box_premium_by_area", "density_income", "dq_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total of best times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": cpus,
        "shuffle_partitions": cpus,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
