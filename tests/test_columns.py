"""Column expressions, under several session time zones."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators import staging
from wayfare.sources import driver_tables


@pytest.fixture(params=["UTC", "Asia/Kolkata", "America/New_York", "Australia/Lord_Howe"])
def zone(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


MOMENTS = [0, -1, 1_710_054_000_000, 1_710_055_800_123, 1_699_164_000_000, 1_550_000_000_000, 86_399_999, -86_400_000]


def test_time_is_utc_in_every_zone(spark, zone):
    made = spark.createDataFrame([(m,) for m in MOMENTS], "ms long").select(
        "ms", c.hour_of_day("ms").alias("h"), c.day_of_week("ms").alias("d"), c.event_time("ms").cast("string").alias("t")
    )
    for row in made.collect():
        moment = datetime.fromtimestamp(row["ms"] / 1000, UTC)
        assert (row["h"], row["d"]) == (moment.hour, moment.isoweekday() % 7)
        assert row["t"][:19] == f"{moment:%Y-%m-%d %H:%M:%S}"


def test_staging_is_the_same_in_every_zone(spark, sf_dir, zone):
    staged = staging.stage_browsing(driver_tables.raw_browsing(spark, sf_dir))
    shown = staged.withColumn("event_ts", F.col("event_ts").cast("string"))
    digest = shown.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*shown.columns) % 1_000_003)).first()
    test_staging_is_the_same_in_every_zone.seen = getattr(test_staging_is_the_same_in_every_zone, "seen", digest)
    assert digest == test_staging_is_the_same_in_every_zone.seen


def values(spark, text: str, column):
    return spark.createDataFrame([(text,)], "s string").select(column).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [(None, None), ("", None), ("   ", None), (" a ", "a"), ("\t", "\t"), ("a b", "a b")],
)
def test_blank_to_null(spark, text, want):
    assert values(spark, text, c.blank_to_null("s")) == want


@pytest.mark.parametrize(
    "text,want",
    [("['a', 'b']", ["a", "b"]), ("['a']", ["a"]), ("", None), (None, None), ("[]", []), (" ['x','x'] ", ["x", "x"])],
)
def test_parse_list(spark, text, want):
    assert values(spark, text, c.parse_list("s")) == want


@pytest.mark.parametrize("text,want", [("[0.1, -2]", [0.1, -2.0]), ("", None), ("[]", []), ("[1e-3]", [0.001])])
def test_parse_vector(spark, text, want):
    assert values(spark, text, c.parse_vector("s")) == want


def test_list_round_trip(spark):
    made = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "v array<string>")
    back = made.select(c.parse_list(c.format_list("v")).alias("v"))
    assert [r["v"] for r in back.collect()] == [["a", "b"], None, None]


def test_hierarchy(spark):
    made = spark.createDataFrame([("a/b/c",), ("a",), (None,), ("a/b/c/d",)], "p string").select(
        *[col.alias(n) for n, col in c.hierarchy("p").items()]
    )
    assert [tuple(r) for r in made.collect()] == [
        (["a", "b", "c"], "a", "b", "c", 3),
        (["a"], "a", None, None, 1),
        (None, None, None, None, None),
        (["a", "b", "c", "d"], "a", "b", "c", 4),
    ]


def test_fingerprint_keeps_null_positions(spark):
    made = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert made.select(c.fingerprint(["x", "y", "z"])).distinct().count() == 2


def test_stage_and_tier(spark):
    stages = spark.createDataFrame([("add",), ("detail",), ("remove",), ("purchase",), (None,), ("else",)], "product_action string")
    assert [r[0] for r in stages.select(c.funnel_stage()).collect()] == [
        "add_to_cart", "product_detail", "remove_from_cart", "purchase", "pageview", "pageview",
    ]
    buckets = spark.createDataFrame([(None,), (1.0,), (3.0,), (4.0,), (7.0,), (8.0,)], "price_bucket double")
    assert [r[0][:3] for r in buckets.select(c.price_tier()).collect()] == ["(un", "low", "low", "mid", "mid", "hig"]


def test_ratios_without_a_whole(spark):
    row = spark.range(1).select(
        c.ratio(F.lit(1), F.lit(0)).alias("a"), c.percent(F.lit(1), F.lit(0)).alias("b"), c.rate(F.lit(1), F.lit(4)).alias("d")
    )
    assert tuple(row.first()) == (None, 0.0, 25.0)


EVENT = (
    "file_row_idx long, session_id_hash string, event_type string, product_action string, "
    "product_sku_hash string, server_timestamp_epoch_ms long, hashed_url string"
)


def test_double_fire_rules(spark):
    made = spark.createDataFrame(
        [
            (0, "s", "event_product", "detail", "k", 5, "u"),
            (1, "s", "pageview", None, None, 5, "u"),  # dropped
            (2, "s", "pageview", None, None, 6, "u"),  # another instant
            (3, "s", "pageview", None, None, 5, "v"),  # another page
            (4, "t", "event_product", "detail", "k", 5, None),
            (5, "t", "pageview", None, None, 5, None),  # page unknown: kept
            (6, "s", None, None, None, 5, "u"),  # type unknown: kept
        ],
        EVENT,
    )
    kept = staging.stage_browsing(made)
    assert sorted(r["file_row_idx"] for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    assert rows(kept) == rows(staging.stage_browsing(made, hot_rows=1, slices=3))


def test_copies_keep_the_first_position(spark):
    made = spark.createDataFrame([(i, "s", "pageview", None, None, 5, "u") for i in (7, 3, 9)], EVENT)
    for staged in (staging.stage_browsing(made), staging.stage_browsing(made, hot_rows=2, slices=2)):
        assert [(r["file_row_idx"], r["raw_row_count"], r["event_seq"]) for r in staged.collect()] == [(3, 3, 1)]
