"""More rows make more tasks, not larger ones."""

from __future__ import annotations

from functools import partial

from conftest import rows

from wayfare.operators import ordered, quality, staging
from wayfare.sources import driver_tables


def test_partitions_grow_with_the_rows(spark):
    parts = [ordered.dealt(spark.range(n), ["id"], 100).rdd.getNumPartitions() for n in (3_000, 30_000)]
    assert parts == [30, 300]
    assert ordered.dealt(spark.range(0), ["id"], 100).count() == 0


def test_profile_and_staging_in_many_small_tasks(spark, sf_dir, monkeypatch):
    raw = driver_tables.raw_browsing(spark, sf_dir)
    for module, make in ((quality, quality.session_profile), (staging, staging.stage_browsing)):
        plain = make(raw)
        monkeypatch.setattr(module, "dealt", partial(ordered.dealt, task_rows=25))
        small = make(raw)
        assert plain.rdd.getNumPartitions() <= 8 < small.rdd.getNumPartitions()
        assert rows(small) == rows(plain)
