"""Tables are replaced as a whole or not at all."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfare.sources import versions


def table(spark, n: int):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).cast("string").alias("v")).repartition(4)


def held(spark, path) -> list[str]:
    return [x for x in versions.children(spark, path) if x.startswith(versions.VERSION)]


def test_replacing_leaves_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 0, 70):
        out = versions.replace_table(table(spark, n), path)
        assert rows(out) == rows(versions.current(spark, path)) == rows(table(spark, n))
        assert versions.pointer(spark, path)["rows"] == n and len(held(spark, path)) == 1
    assert versions.current(spark, path).dtypes == table(spark, 1).dtypes


def test_a_write_that_fails_half_way_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(table(spark, 9), path)
    late = table(spark, 900).withColumn("v", F.when(F.col("k") == 777, F.raise_error(F.lit("late"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="late"):
        versions.replace_table(late, path)
    assert rows(versions.current(spark, path)) == rows(table(spark, 9)) and len(held(spark, path)) == 1


def test_a_version_that_is_not_accepted_is_not_pointed_to(spark, tmp_path):
    path = str(tmp_path / "t")

    def refuse(df):
        if df.count() > 10:
            raise ValueError("too many")

    versions.replace_table(table(spark, 9), path, refuse, expected=9)
    with pytest.raises(RuntimeError, match="8 rows loaded, source has 9"):
        versions.replace_table(table(spark, 8), path, expected=9)
    with pytest.raises(ValueError, match="too many"):
        versions.replace_table(table(spark, 11), path, refuse)
    assert versions.current(spark, path).count() == 9 and len(held(spark, path)) == 1


def test_a_table_may_be_made_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(table(spark, 9), path)
    versions.replace_table(versions.current(spark, path).filter("k > 3"), path)
    assert versions.current(spark, path).count() == 5


def test_earlier_versions_on_request_and_leftovers_of_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3, 4):
        versions.replace_table(table(spark, n), path, keep=2)
    assert [versions.version_of(spark, path, k).count() for k in (1, 2)] == [3, 2] and len(held(spark, path)) == 3
    table(spark, 50).write.parquet(f"{path}/{versions.VERSION}dead")  # a writer that died before its pointer
    assert versions.current(spark, path).count() == 4
    versions.replace_table(table(spark, 6), path)
    assert len(held(spark, path)) == 1 and versions.current(spark, path).count() == 6


def test_plain_folders_are_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, 8).write.parquet(path)
    assert versions.current(spark, path).count() == 8
    versions.replace_table(table(spark, 3), path)
    assert versions.current(spark, path).count() == 3
    assert [x for x in versions.children(spark, path) if x.endswith(".parquet") or x == "_SUCCESS"] == []
