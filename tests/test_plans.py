"""The physical plans: few shuffles, narrow scans, no row-by-row Python, no pairings without a key."""

from __future__ import annotations

import re

import pytest

from wayfare.operators import marts, quality, staging
from wayfare.plans.queries import QUERIES
from wayfare.plans.warehouse import of_driver_tables

FITS = {"fit_gbt", "fit_logistic", "fitted_curves", "leakage_demo", "model_comparison", "model_findings", "check_models"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)[^\n]*", plan(df))


@pytest.fixture(scope="module")
def warehouse(spark, sf_dir):
    return of_driver_tables(spark, sf_dir)


def test_staging_moves_rows_once(spark, warehouse):
    staged = staging.stage_browsing(warehouse["raw_browsing"])
    assert len(exchanges(staged)) == 1, plan(staged)


def test_session_profile_moves_rows_once(warehouse):
    """Two window orders and four nested groupings behind one shuffle."""
    profile = quality.session_profile(warehouse["raw_browsing"])
    assert len(exchanges(profile)) == 1, plan(profile)


def test_session_fact_moves_only_partial_sums(spark, warehouse):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = warehouse.define("fct_session")
        assert len(exchanges(fact)) == 2
        text = plan(fact)
        assert "Expand" not in text and text.count("partial_") > 0
        # The click and result lists are not read.
        assert "valid_clicked_skus" not in text and "result_skus" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_product_mart_counts_sessions_without_distinct(warehouse):
    text = plan(marts.product_performance(warehouse["stg_browsing"], warehouse["dim_product"]))
    assert "distinct" not in text and "Expand" not in text
    scan = re.search(r"ReadSchema: (struct<[^\n]*product_sku_hash:string,funnel_stage[^\n]*)", text) or re.search(
        r"ReadSchema: (struct<product_sku_hash[^\n]*)", text
    )
    assert "server_timestamp" not in scan.group(1)


def test_cart_features_stay_hash_aggregated(warehouse):
    text = plan(warehouse.define("ml_cart_sessions"))
    assert "SortAggregate" not in text
    assert "PushedFilters: [IsNotNull(cart_seq)" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_no_costly_operator(spark, sf_dir, name):
    """No pairing without a key, no Python, and only partial aggregates meet in a single task."""
    text = plan(QUERIES[name](spark, sf_dir))
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert costly not in text, name
    lines = text.splitlines()
    for line, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            assert "Aggregate(" in below, (name, below)


def test_fingerprint_dedup_reads_one_written_table(warehouse):
    """The second stage is for colliding fingerprints only; without one the result is a filter over the first."""
    assert exchanges(staging.dedup_events_by_fingerprint(staging.usable_events(warehouse["raw_browsing"]))) == []
