"""Row-level parity: every difference is named, equal tables move no rows, only differing buckets are compared."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_plans import exchanges, plan

from wayfare.operators import parity
from wayfare.plans.warehouse import of_driver_tables

SCHEMA = "k long, j string, v double, w string"


def table(spark, n: int = 3000):
    rng = random.Random(4)
    made = [(i // 2 if i % 50 else None, rng.choice("ab"), rng.choice([None, 1.0, -0.5]), rng.choice([None, "", "x"])) for i in range(n)]
    return made, spark.createDataFrame(made, SCHEMA).repartition(6)


def found(df) -> set:
    return {(r["k"], r["j"], r["n_left"], r["n_right"], r["kind"], r["columns"]) for r in df.collect()}


@pytest.mark.parametrize("leaf_rows,depth", [(1_000_000, 4), (10, 4), (0, 2)])
def test_differences_are_named(spark, leaf_rows, depth):
    made, left = table(spark)
    made = list(made)
    assert parity.differences(left, spark.createDataFrame(made[::-1], SCHEMA), ["k", "j"], leaf_rows, depth).count() == 0
    changed = list(made)
    k, j, v, w = changed[7]
    changed[7] = (k, j, 99.0, w)
    lost = changed.pop(1001)
    changed.append((123_456, "new", None, None))
    changed.append(changed[20])  # one more copy of a row
    right = spark.createDataFrame(changed, SCHEMA).select("w", "v", "k", "j")
    count = {side: {} for side in "lr"}
    for side, held in (("l", made), ("r", changed)):
        for row in held:
            count[side].setdefault(row[:2], []).append(row[2:])
    want = set()
    for key in count["l"].keys() | count["r"].keys():
        a, b = (count[s].get(key, []) for s in "lr")
        if sorted(map(repr, a)) != sorted(map(repr, b)):
            kind = "missing" if not b else "extra" if not a else "changed"
            names = [n for i, n in enumerate("vw") if sorted(map(repr, [x[i] for x in a])) != sorted(map(repr, [x[i] for x in b]))]
            want.add((*key, len(a), len(b), kind, ",".join(names) if kind == "changed" else ""))
    assert lost[:2] in {w[:2] for w in want} and len(want) == 4
    assert found(parity.differences(left, right, ["k", "j"], leaf_rows, depth)) == want


def test_swapped_nulls_and_columns_are_seen(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, a string, b string")
    b = spark.createDataFrame([(1, "x", None)], "k int, a string, b string")
    assert [(r["kind"], r["columns"]) for r in parity.differences(a, b, ["k"]).collect()] == [("changed", "a,b")]
    with pytest.raises(ValueError, match="columns differ"):
        parity.differences(a, b.drop("b"), ["k"])
    assert parity.differences(a.limit(0), b.limit(0), ["k"]).count() == 0
    assert [r["kind"] for r in parity.differences(a, b.limit(0), ["k"]).collect()] == ["missing"]


def test_one_changed_cell_is_found_without_joining_the_tables(spark, sf_dir):
    fact = of_driver_tables(spark, sf_dir)["fct_session"]
    one = fact.agg(F.max("session_id_hash")).first()[0]
    copy = fact.withColumn("n_adds", F.when(F.col("session_id_hash") == one, F.col("n_adds") + 1).otherwise(F.col("n_adds")))
    out = parity.differences(fact, copy, ["session_id_hash"], leaf_rows=0)
    assert [tuple(r) for r in out.collect()] == [(one, 1, 1, "changed", "n_adds")]
    # What is compared by key is a sliver of the table: the rows of the last differing buckets.
    columns = sorted(fact.columns)
    a, b = (parity._placed(x, ["session_id_hash"], columns) for x in (fact, copy))
    buckets = parity.differing_buckets(a, b, 2)
    assert buckets.count() == 1 and buckets.first()["n"] < fact.count() / 20
    text = plan(parity.digests(a))
    assert "Join" not in text and len(exchanges(parity.digests(a))) == 1 and "partial_sum" in text
    assert rows(parity.digests(a)) == rows(parity.digests(a.repartition(3)))
