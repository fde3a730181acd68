"""Wide rows cross the network once: lines of orders, numbered rows, entries of encoded lists."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import surrogates
from wayfare.operators.ordered import dealt, number_sliced
from wayfare.sources import driver_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_move_by_order_only(spark, sf_dir, monkeypatch):
    searches = driver_tables.raw_search(spark, sf_dir)
    assert plan(searches).count("Exchange hashpartitioning(l_orderkey") == 1
    monkeypatch.setattr(driver_tables, "dealt", lambda df, keys, _: dealt(df, keys, 100))
    small = driver_tables.raw_search(spark, sf_dir)
    assert "hashpartitioning(l_orderkey" in plan(small) and rows(small) == rows(searches)


def test_numbered_rows_are_not_moved_again(spark):
    table = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 389 % 1000).alias("v"))
    for keys in ([], ["k"]):
        numbered = number_sliced(table, keys, [F.col("v").desc()], "n", 9)
        assert "hashpartitioning(v" not in plan(numbered) and plan(numbered).count("Window ") == 1  # of the slices' borders
        by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        expected = table.withColumn("n", F.row_number().over(by.orderBy(F.col("v").desc())).cast("bigint"))
        assert rows(numbered) == rows(expected)


def test_lists_are_encoded_together_and_their_texts_move_once(spark):
    data = [(1, "s", ["b", "a", None, "b"], ["c"]), (2, "t", [], None), (3, None, None, ["a", "a"]), (4, "s", ["c"], [])]
    table = spark.createDataFrame(data, "row long, name string, l array<string>, m array<string>")
    letters = surrogates.dictionary(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"))
    whole = surrogates.encode_lists(table, ["l", "m"], letters, "row", lambda rest: rest.withColumn("name", F.upper("name")))
    assert whole.columns == table.columns
    expected = {1: ("S", [1, 0, None, 1], [2]), 2: ("T", [], None), 3: (None, None, [0, 0]), 4: ("S", [2], [])}
    assert {r["row"]: (r["name"], r["l"], r["m"]) for r in whole.collect()} == expected
