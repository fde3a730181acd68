"""Ranking metrics on tables small enough to work out by hand, and against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import metrics, model

HAND = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (0, 0.1)]


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame([(y, s) for y, s in HAND], "label int, score double")


def brute(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    area, hits, seen, recall = 0.0, 0, 0, 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        block = [y for y, t in pairs if t == s]
        hits, seen = hits + sum(block), seen + len(block)
        area += (hits / len(pos) - recall) * hits / seen
        recall = hits / len(pos)
    return auc, area, sum((s - y) ** 2 for y, s in pairs) / len(pairs)


def test_by_hand(hand):
    assert metrics.roc_auc(hand).first()[0] == pytest.approx(5.5 / 6)
    assert metrics.average_precision(hand).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.brier(hand).first()[0] == pytest.approx((0.01 + 0.64 + 0.04 + 0.09 + 0.01) / 5)


def test_ties_count_by_expectation(spark):
    same = spark.createDataFrame([(i % 4 == 0, 0.5) for i in range(40)], "y boolean, score double").select(
        F.col("y").cast("int").alias("label"), "score"
    )
    for row in metrics.lift_at_k(same).collect():
        assert (row["precision"], row["lift"]) == (pytest.approx(0.25), pytest.approx(1.0))
    assert metrics.roc_auc(same).first()[0] == 0.5


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_against_brute_force(spark, slices):
    rng = random.Random(slices)
    pairs = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    table = spark.createDataFrame(pairs, "label int, score double").repartition(5)
    row = metrics.evaluate(table, "m", slices).first()
    auc, area, brier = brute(pairs)
    assert (row["roc_auc"], row["pr_auc"], row["brier"]) == (pytest.approx(auc), pytest.approx(area), pytest.approx(brier))
    best = sorted(pairs, key=lambda p: -p[1])
    cut = best[39][1]
    certain = [y for y, s in pairs if s > cut]
    tied = [y for y, s in pairs if s == cut]
    expected = (sum(certain) + sum(tied) / len(tied) * (40 - len(certain))) / 40
    assert row["prec_top10"] == pytest.approx(expected)


def test_curves(hand):
    roc = [tuple(r) for r in metrics.roc_curve(hand).orderBy(F.desc("threshold")).collect()]
    assert roc == [(0.9, 0.0, 0.5), (0.8, 1 / 3, 1.0), (0.3, 2 / 3, 1.0), (0.1, 1.0, 1.0)]
    pr = [tuple(r) for r in metrics.pr_curve(hand).orderBy(F.desc("threshold")).collect()]
    assert pr == [(0.9, 1.0, 0.5), (0.8, 2 / 3, 1.0), (0.3, 0.5, 1.0), (0.1, 0.4, 1.0)]


def test_one_class_only(spark):
    table = spark.createDataFrame([(0, 0.1), (0, 0.7)], "label int, score double")
    row = metrics.evaluate(table, "m").first()
    assert row["roc_auc"] is None and row["base_rate"] == 0.0 and row["lift_top10"] is None


def test_split_breaks_ties_by_session(spark):
    table = spark.createDataFrame([(f"s{i}", 5) for i in range(10)], "session_id_hash string, add_ts long")
    train = model.temporal_split(table, slices=3).filter("is_train")
    assert sorted(r["session_id_hash"] for r in train.collect()) == [f"s{i}" for i in range(8)]


def test_statistics_and_scaling(spark):
    made = [(float(i) if i % 5 else None, 3.0, None) for i in range(21)]
    table = spark.createDataFrame(made, "a double, b double, e double")
    known = [v for v, *_ in made if v is not None]
    median = sorted(known)[len(known) // 2 - 1 : len(known) // 2 + 1]
    median = sum(median) / 2 if len(known) % 2 == 0 else sorted(known)[len(known) // 2]
    filled = [median if v is None else v for v, *_ in made]
    mean = sum(filled) / len(filled)
    deviation = (sum((v - mean) ** 2 for v in filled) / len(filled)) ** 0.5
    statistics = model.numeric_statistics(table, ["a", "b", "e"], 3)
    found = {r["feature"]: r for r in statistics.collect()}
    assert (found["a"]["median"], found["a"]["mean"], found["a"]["deviation"]) == (
        median, pytest.approx(mean), pytest.approx(deviation),
    )
    scaled = model.impute_scale(table, statistics, ["a", "b", "e"]).collect()
    assert [r["a"] for r in scaled] == pytest.approx([(v - mean) / deviation for v in filled])
    assert {r["b"] for r in scaled} == {0.0} and {r["e"] for r in scaled} == {0.0}


def test_category_levels(spark):
    sizes = {"x": 60, "y": 55, "rare": 3, "rarer": 1}
    table = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "category_lvl1 string")
    levels = {r[0]: (r[1], r[2]) for r in model.category_levels(table, 3).collect()}
    assert levels == {"x": ("x", 0), "y": ("y", 1), "rare": (model.INFREQUENT, 2), "rarer": (model.INFREQUENT, 2)}
    unseen = spark.createDataFrame([("new",)], "category_lvl1 string")
    assert model.encode_category(unseen, model.category_levels(table)).first()["level"] is None
    names = {r["category_lvl1"]: r["category"] for r in model.category_pseudonym(table).collect()}
    assert names == {"x": "Cat00", "y": "Cat01", "rare": "Cat02", "rarer": "Cat03"}
