"""Filters on day, session and SKU skip folders and row groups; the rows are right."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_plans import plan

from wayfare.sources import clustered

DAY_MS = 86_400_000


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    made = [
        (i, f"s{rng.getrandbits(64):016x}" if i % 3 else "hot", f"k{2 * rng.randrange(20_000):06d}", 1_700_006_400_000 + rng.randrange(5 * DAY_MS))
        for i in range(40_000)
    ]
    made.append((-1, "late", "k000001", None))
    schema = "file_row_idx long, session_id_hash string, product_sku_hash string, server_timestamp_epoch_ms long"
    return spark.createDataFrame(made, schema).repartition(6)


@pytest.fixture(scope="module")
def table(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "events")
    return clustered.write_clustered(events, path, row_group_bytes=64 << 10, parts=8, distinct_values=2000)


def scanned(df) -> int:
    """Rows that left the scan: those of the row groups that were not skipped."""
    df = df.select("file_row_idx", "session_id_hash", "product_sku_hash")
    df.collect()
    seen, total = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.finalPhysicalPlan())
            continue
        if name.endswith("QueryStageExec"):
            seen.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
    return total


def test_all_rows_are_kept(events, table):
    assert rows(table.drop(clustered.DAY).select(*events.columns)) == rows(events)


def test_a_day_filter_reads_its_folder(events, table):
    some = clustered.events_between(table, "2023-11-16", "2023-11-16")
    want = events.filter(F.to_date(F.timestamp_millis("server_timestamp_epoch_ms")) == F.lit("2023-11-16").cast("date"))
    assert rows(some.drop(clustered.DAY).select(*events.columns)) == rows(want)
    assert "PartitionFilters: [isnotnull(event_day" in plan(some)
    assert scanned(some) == want.count() < events.count() / 3


def test_a_session_filter_skips_row_groups(events, table):
    one = events.filter("session_id_hash <> 'hot' and server_timestamp_epoch_ms is not null").agg(F.max("session_id_hash")).first()[0]
    some = clustered.events_of(table, "session_id_hash", [one])
    assert rows(some.select(*events.columns)) == rows(events.filter(F.col("session_id_hash") == one))
    assert scanned(some) < events.count() / 10


def test_a_bloom_filter_skips_row_groups_of_an_absent_sku(spark, events, table, tmp_path):
    """Odd numbers are in the range of every row group, but in none of them."""
    absent = [f"k{n:06d}" for n in (20_001,)]
    assert clustered.events_of(table, "product_sku_hash", absent).count() == 0
    plain = clustered.write_clustered(events, str(tmp_path / "plain"), bloom=(), row_group_bytes=64 << 10, parts=8)
    without = scanned(clustered.events_of(plain, "product_sku_hash", absent))
    with_bloom = scanned(clustered.events_of(table, "product_sku_hash", absent))
    assert with_bloom < without / 5


def test_keys_of_a_table(spark, events, table):
    wanted = events.select("session_id_hash").filter("session_id_hash like 's00%'").distinct()
    found = clustered.events_of_table(table, wanted, "session_id_hash")
    assert rows(found.select(*events.columns)) == rows(events.filter("session_id_hash like 's00%'"))


def test_an_existing_table_is_not_overwritten(events, tmp_path):
    clustered.write_clustered(events.limit(10), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        clustered.write_clustered(events.limit(10), str(tmp_path / "t"))
