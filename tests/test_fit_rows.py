"""The fits read their rows in a thousand short stages, so the rows lie in equal parts, a whole number of them per core."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.operators import model, ordered
from wayfare.plans.warehouse import of_driver_tables


def sizes(df) -> list[int]:
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]


def test_parts_are_full_rounds_of_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(10_000 * cores).coalesce(1)
    for n, parts in ((1, cores), (10_000 * cores, 2 * cores), (15_001 * cores, 4 * cores)):
        dealt = ordered.dealt_evenly(rows, ["id"], n, task_rows=5_000)
        assert dealt.rdd.getNumPartitions() == parts
        assert max(sizes(dealt)) < 1.2 * rows.count() / parts


def test_rows_of_the_fits_are_dealt_evenly(spark, sf_dir):
    tables = of_driver_tables(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    carts, sessions = tables["ml_cart_sessions"].coalesce(1), tables["fct_session"].coalesce(1)
    for made in (model.prepared(carts), model.leaky_rows(sessions, model.WHOLE_SESSION)):
        assert made.count() == carts.count()
        assert made.rdd.getNumPartitions() == cores
        assert max(sizes(made)) < 3 * made.count() / cores
