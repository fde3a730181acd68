"""Bucketed session tables: equal rows, no exchange by session, hot sessions apart, layouts that are found again."""

from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_hot_keys import searches, skewed  # noqa: F401
from test_plans import exchanges, plan

from wayfare.operators import features, marts
from wayfare.plans.warehouse import Warehouse, of_driver_tables, session_marts, session_tables
from wayfare.sources.bucketed import open_bucketed, write_bucketed


def by_session(df) -> list[str]:
    return [x for x in exchanges(df) if "session_id_hash" in x]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_marts_move_nothing_by_session(spark, sf_dir, tmp_path, no_broadcast):
    warehouse = of_driver_tables(spark, sf_dir)
    tables = session_tables(warehouse, str(tmp_path), 4)
    found = session_marts(tables, warehouse["dim_product"])
    assert exchanges(found["fct_session"]) == []
    assert by_session(found["ml_cart_sessions"]) == []
    merged = features.pre_search_features(features.first_add(warehouse["stg_browsing"]), warehouse["stg_search"], hot=None)
    assert "Join" not in plan(merged) and len(exchanges(merged)) == 1
    for name in ("fct_session", "ml_cart_sessions"):
        assert rows(found[name]) == rows(warehouse[name]), name
    # The same from an earlier session's folder.
    again = open_bucketed(spark, f"{tmp_path}/stg_browsing/ordinary")
    asked = open_bucketed(spark, f"{tmp_path}/stg_search/ordinary")
    fact = marts.session_fact(again, asked)
    assert exchanges(fact) == [] and rows(fact) == rows(warehouse["fct_session"])


def test_one_shuffle_on_the_way_in(spark, sf_dir):
    from wayfare.operators import staging

    staged, large = staging.stage_parts(of_driver_tables(spark, sf_dir)["raw_browsing"], None, parts=4)
    assert large is None and len(exchanges(staged.repartition(4, "session_id_hash"))) == 1


@pytest.mark.parametrize("hot_rows", [500, 20, 3])
def test_hot_sessions_lie_apart(skewed, searches, tmp_path, hot_rows):  # noqa: F811
    spark = skewed.sparkSession
    catalog = spark.createDataFrame(
        [(f"k{i}", "a/b", ["a", "b"], "a", "b", None, 2, float(i % 10 + 1)) for i in range(0, 25, 2)],
        "product_sku_hash string, category_hash string, category_path array<string>, category_lvl1 string, "
        "category_lvl2 string, category_lvl3 string, category_depth long, price_bucket double",
    )
    plain = Warehouse({"raw_browsing": lambda: skewed, "raw_search": lambda: searches, "raw_catalog": lambda: catalog})
    tables = session_tables(plain, str(tmp_path), 5, hot_rows)
    ordinary, large = tables._parts["stg_browsing"]
    most = ordinary.groupBy("session_id_hash").count().agg(F.max("count")).first()[0] or 0
    assert most <= hot_rows and large.filter("session_id_hash = 'bot'").count() > 400
    assert ordinary.filter("session_id_hash = 'bot'").count() == 0
    assert rows(tables.table("stg_browsing")) == rows(plain["stg_browsing"])
    found = session_marts(tables, plain["dim_product"])
    for name in ("fct_session", "ml_cart_sessions"):
        assert rows(found[name]) == rows(plain[name]), name


def test_buckets_hold_whole_keys(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 37).cast("string").alias("k"), "id").repartition(9)
    table = write_bucketed(df, f"{tmp_path}/t", ["k"], 6)
    bucket = F.regexp_extract(F.input_file_name(), r"_(\d{5})\.", 1).alias("bucket")
    places = table.select("k", bucket).distinct().groupBy("k").agg(F.count("*").alias("n"))
    assert places.filter("n <> 1").count() == 0 and rows(table) == rows(df)
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 6
    with pytest.raises(Exception, match=re.compile("exist", re.I)):
        write_bucketed(df, f"{tmp_path}/t", ["k"], 6)
