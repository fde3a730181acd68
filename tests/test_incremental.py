"""An update from new rows gives the tables of a full build, and computes touched sessions only."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_hot_keys import searches, skewed  # noqa: F401

from wayfare.operators import incremental, marts
from wayfare.plans.warehouse import Warehouse

CATALOG = (
    "product_sku_hash string, category_hash string, category_path array<string>, category_lvl1 string, "
    "category_lvl2 string, category_lvl3 string, category_depth long, price_bucket double"
)


def built(spark, browsing, asked):
    made = [(f"k{i}", "a/b", ["a", "b"], "a", "b", None, 2, float(i % 10 + 1)) for i in range(0, 25, 2)]
    catalog = spark.createDataFrame(made, CATALOG)
    raw = {"raw_browsing": lambda: browsing, "raw_search": lambda: asked, "raw_catalog": lambda: catalog}
    house = Warehouse(raw)
    tables = {n: house[n] for n in incremental.KEPT if n != "product_counts"}
    return tables | {"product_counts": marts.product_counts(house["stg_browsing"])}, catalog


@pytest.mark.parametrize("cut", ["file_row_idx % 7 = 3", "session_id_hash = 's1'", "file_row_idx > 1500", "false"])
def test_update_equals_a_full_build(skewed, searches, cut):  # noqa: F811
    """New rows among the old in time and place, copies of old rows, details that pair with old pageviews."""
    spark = skewed.sparkSession
    new, asked = skewed.filter(cut), searches.filter(cut)
    old, old_asked = skewed.filter(f"coalesce(not ({cut}), true)"), searches.filter(f"not ({cut})")
    kept, catalog = built(spark, old, old_asked)
    full, _ = built(spark, skewed, searches)
    found = incremental.update(kept, old, new, asked, catalog)
    assert set(found) == set(incremental.KEPT)
    for name in incremental.KEPT:
        assert rows(found[name].select(*full[name].columns)) == rows(full[name]), name


def test_hot_sessions_in_an_update(skewed, searches):  # noqa: F811
    spark = skewed.sparkSession
    new, old = skewed.filter("file_row_idx > 1700"), skewed.filter("file_row_idx <= 1700")
    kept, catalog = built(spark, old, searches)
    full, _ = built(spark, skewed, searches)
    found = incremental.update(kept, old, new, searches.limit(0), catalog, hot_rows=50, slices=4)
    for name in ("stg_browsing", "fct_session", "ml_cart_sessions"):
        assert rows(found[name].select(*full[name].columns)) == rows(full[name]), name


def test_only_touched_sessions_are_computed(skewed, searches):  # noqa: F811
    spark = skewed.sparkSession
    new, old = skewed.filter("session_id_hash in ('s1', 's2')"), skewed.filter("session_id_hash not in ('s1', 's2')")
    kept, _ = built(spark, old, searches)
    moved = incremental.change(kept, old, new, searches.limit(0))
    assert {r[0] for r in moved.sessions.collect()} == {r[0] for r in moved.after.select("session_id_hash").distinct().collect()} == {"s1", "s2"}
    assert moved.before.count() == 0 and moved.searches.filter(~F.col("session_id_hash").isin("s1", "s2")).count() == 0


def test_a_sku_goes_with_its_last_event(spark):
    schema = "file_row_idx long, session_id_hash string, event_type string, product_action string, product_sku_hash string, server_timestamp_epoch_ms long, hashed_url string"
    old = spark.createDataFrame([(0, "s", "pageview", None, "gone", 5, "u"), (1, "s", "pageview", None, "k0", 9, "u")], schema)
    new = spark.createDataFrame([(2, "s", "event_product", "detail", "k1", 5, "u")], schema)
    asked = spark.createDataFrame([], "file_row_idx long, session_id_hash string, server_timestamp_epoch_ms long, product_skus array<string>, clicked_skus array<string>")
    kept, catalog = built(spark, old, asked)
    full, _ = built(spark, old.unionByName(new), asked)
    found = incremental.update(kept, old, new, asked, catalog)
    assert kept["dim_product"].filter("product_sku_hash = 'gone'").count() == 1
    for name in incremental.KEPT:
        assert rows(found[name].select(*full[name].columns)) == rows(full[name]), name


def test_touched_sessions_are_not_broadcast(spark):
    """However small they are now: they grow with the log, and a broadcast goes through the driver."""
    table = spark.range(1000).selectExpr("cast(id as string) as session_id_hash", "id")
    touched = table.filter("id % 10 = 0").select("session_id_hash")
    for found, n in ((incremental.of_sessions(table, touched), 100), (incremental.upsert(table, table.limit(0), touched), 900)):
        assert found.count() == n
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
