"""Contracts, exports and the checked load."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfare.operators import quality
from wayfare.plans.warehouse import of_driver_tables
from wayfare.sources import sinks


@pytest.fixture(scope="module")
def marts(spark):
    warehouse = of_driver_tables(spark, "/root/testdata/sf0.001")
    return {n: warehouse[n] for n in sinks.CONTRACTS}


@pytest.mark.parametrize("name", list(sinks.CONTRACTS))
def test_marts_keep_their_contract(marts, name):
    held = sinks.enforce_contract(marts[name], sinks.CONTRACTS[name], name)
    assert held.columns == sinks.CONTRACTS[name].fieldNames()


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda df: df.drop("n_adds"), "missing n_adds"),
        (lambda df: df.withColumn("extra", F.lit(1)), "undeclared extra"),
        (lambda df: df.withColumn("n_adds", F.col("n_adds").cast("double")), "n_adds is double"),
        (lambda df: df.withColumn("n_adds", F.col("n_adds").cast("decimal(38,0)")), "n_adds is decimal"),
    ],
)
def test_drift_raises(marts, change, message):
    with pytest.raises(ValueError, match=message):
        sinks.enforce_contract(change(marts["fct_session"]), sinks.CONTRACTS["fct_session"], "fct_session")


@pytest.mark.parametrize("header", [True, False])
def test_csv_round_trip(spark, marts, tmp_path, header):
    for name, contract in sinks.CONTRACTS.items():
        path = str(tmp_path / f"{name}-{header}")
        sinks.export_csv(marts[name], contract, path, header)
        assert rows(sinks.read_export(spark, contract, path, header)) == rows(marts[name])


def test_null_and_empty_text_stay_apart(spark, tmp_path):
    made = spark.createDataFrame([("", None, 'a "q", b')], "a string, b string, c string")
    sinks.export_csv(made, made.schema, str(tmp_path / "t"))
    assert tuple(sinks.read_export(spark, made.schema, str(tmp_path / "t")).first()) == ("", None, 'a "q", b')


def test_load_replaces_and_counts(spark, marts, tmp_path):
    target = str(tmp_path / "serving")
    for _ in range(2):
        report = sinks.load_serving(marts, target).collect()
    assert [r["table_name"] for r in report][0] == "dim_product"
    assert all(r["source_rows"] == r["loaded_rows"] > 0 for r in report)
    copy = sinks.read_serving(spark, target)
    for name in sinks.CONTRACTS:
        assert rows(copy[name]) == rows(marts[name])


def test_partial_load_raises(spark, marts, tmp_path, monkeypatch):
    whole = sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, path, **more: whole(df.limit(1), path, **more))
    with pytest.raises(RuntimeError, match="loaded"):
        sinks.load_serving(marts, str(tmp_path / "serving"))


def test_parity_sees_a_difference(spark, marts):
    def values(sessions):
        return quality.parity_values({**marts, "fct_session": sessions})

    whole = values(marts["fct_session"])
    assert whole.count() == 19
    assert quality.parity(whole, whole).filter("not matches").count() == 0
    moved = marts["fct_session"].withColumn("session_start", F.col("session_start") + F.expr("interval 5 hours"))
    assert {r["label"] for r in quality.parity(whole, values(moved)).filter("not matches").collect()} == {
        "fct_session.first_session_start", "fct_session.last_session_start",
    }


def test_constraints_see_violations(marts):
    broken = marts["fct_session"].withColumns({"strict_purchase": F.lit(True), "n_adds": F.lit(None).cast("bigint")})
    twice = broken.union(broken)
    found = quality.constraint_violations(twice, marts["fct_product_performance"], marts["dim_product"].limit(3))
    counts = {r["rule"]: r["violations"] for r in found.collect()}
    for rule in ("strict_implies_attained", "fct_session_not_null", "fct_session_unique", "product_in_dimension"):
        assert counts[rule] > 0, rule
    assert counts["dim_product_not_null"] == 0


@pytest.mark.parametrize(
    "table,change,rule",
    [
        ("fct_session", lambda df: df.withColumn("strict_purchase", F.lit(True)).withColumn("reached_purchase", F.lit(False)), "strict_implies_attained"),
        ("fct_session", lambda df: df.withColumn("cart_abandoned", F.lit(True)).withColumn("reached_add", F.lit(False)), "abandoned_implies_add"),
        ("fct_session", lambda df: df.unionByName(df), "fct_session_unique"),
        ("dim_product", lambda df: df.unionByName(df), "dim_product_unique"),
        ("fct_product_performance", lambda df: df.unionByName(df), "fct_product_performance_unique"),
        ("dim_product", lambda df: df.limit(1), "product_in_dimension"),
    ],
)
def test_broken_rules_stop_the_load(marts, tmp_path, table, change, rule):
    with pytest.raises(RuntimeError, match=rule):
        sinks.load_serving({**marts, table: change(marts[table])}, str(tmp_path / "serving"))
