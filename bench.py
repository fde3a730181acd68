"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line.

The warehouse (staged tables and marts) is built first and timed table by table, as `build:*`; the queries
after it read the built tables, the way reports do. Each query is drained into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wayfare.plans.queries import QUERIES  # noqa: E402
from wayfare.plans.warehouse import of_driver_tables  # noqa: E402
from wayfare.session import local_session  # noqa: E402

TABLES = [
    "raw_search",
    "session_profile",
    "stg_browsing",
    "stg_search",
    "dim_product",
    "fct_session",
    "fct_product_performance",
    "ml_cart_sessions",
    "model_rows",
    "leaky_rows",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, partitions=int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query

    seconds: dict[str, float] = {}
    warehouse = of_driver_tables(spark, sf_dir)
    for name in TABLES:
        seconds[f"build:{name}"] = timed(lambda name=name: warehouse[name])
    wanted = os.environ.get("BENCH_QUERIES", "").split()
    for name, query in QUERIES.items():
        if wanted and name not in wanted:
            continue
        seconds[name] = timed(lambda query=query: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(seconds.values()), 3)
    result = {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
