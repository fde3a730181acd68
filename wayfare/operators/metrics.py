"""Ranking metrics of scored rows as DataFrame aggregates: exact, distributed, ties by expectation.

Input: a table with a 0/1 `label` and a double `score`. Rows of equal score form one block (merged before
the shuffle); running totals over blocks by falling score come from range slices, so a hot score or a
large test set never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.ordered import running_totals
from wayfare.operators.tables import one_row, stacked

TOP = {"top10": 10, "top20": 5}  # fixed values: the best n div 10 and n div 5 rows


def score_blocks(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per score: size, positives, and both accumulated from the best score down."""
    blocks = scored.groupBy(F.col("score").cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")
    )
    sums = {"n": "n_upto", "pos": "pos_upto"}
    return running_totals(blocks, [], [F.col("score").desc()], sums, slices)


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def _auc() -> Column:
    """Chance that a positive outranks a negative, ties counting half."""
    negatives = _double("n") - _double("pos")
    outranked = _double("pos_upto") - _double("pos") / 2
    all_pos, all_neg = _double("pos_upto_total"), _double("n_upto_total") - _double("pos_upto_total")
    pairs = F.max(all_pos * all_neg)
    return F.sum(negatives * outranked) / F.nullif(pairs, F.lit(0.0))


def _average_precision() -> Column:
    """Sum of precision times the step in recall, from the best score down."""
    recall_step = _double("pos") / F.nullif(_double("pos_upto_total"), F.lit(0.0))
    return F.sum(recall_step * _double("pos_upto") / _double("n_upto"))


def _precision_in_top(part: int) -> Column:
    """Positives among the best n div `part` rows. A tied block that is cut counts by expectation."""
    wanted = F.greatest(F.expr(f"n_upto_total div {part}"), F.lit(1).cast("bigint"))
    before = F.col("n_upto") - F.col("n")
    taken = F.greatest(F.least(F.col("n_upto"), wanted) - before, F.lit(0).cast("bigint"))
    hits = _double("pos") * taken.cast("double") / _double("n")
    return F.sum(hits) / F.max(wanted)


def roc_auc(scored: DataFrame, slices: int | None = None) -> DataFrame:
    return score_blocks(scored, slices).agg(_auc().alias("roc_auc"))


def average_precision(scored: DataFrame, slices: int | None = None) -> DataFrame:
    return score_blocks(scored, slices).agg(_average_precision().alias("pr_auc"))


def brier(scored: DataFrame) -> DataFrame:
    miss = F.col("score").cast("double") - F.col("label").cast("double")
    return scored.agg(F.avg(miss * miss).alias("brier"))


def _base_rate() -> Column:
    return F.max(_double("pos_upto_total") / _double("n_upto_total"))


def lift_at_k(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """Precision in the best 10 % and 20 %, and lift over the base rate: one row per fraction."""
    row = score_blocks(scored, slices).agg(
        _base_rate().alias("base_rate"),
        *[_precision_in_top(part).alias(f"prec_{name}") for name, part in TOP.items()],
    )
    base = F.nullif(F.col("base_rate"), F.lit(0.0))
    return stacked(
        row,
        ["top", "base_rate", "precision", "lift"],
        [(F.lit(n), F.col("base_rate"), F.col(f"prec_{n}"), F.col(f"prec_{n}") / base) for n in TOP],
    )


def evaluate(scored: DataFrame, model: str, slices: int | None = None) -> DataFrame:
    """One row of all metrics under a model name."""
    row = one_row(
        score_blocks(scored, slices).agg(
            F.max("n_upto_total").alias("n_rows"),
            _base_rate().alias("base_rate"),
            _auc().alias("roc_auc"),
            _average_precision().alias("pr_auc"),
            *[_precision_in_top(part).alias(f"prec_{name}") for name, part in TOP.items()],
        ),
        brier(scored),
    )
    base = F.nullif(F.col("base_rate"), F.lit(0.0))
    return row.select(
        F.lit(model).alias("model"),
        "n_rows",
        "base_rate",
        "roc_auc",
        "pr_auc",
        (F.col("pr_auc") / base).alias("pr_lift"),
        "brier",
        "prec_top10",
        (F.col("prec_top10") / base).alias("lift_top10"),
        "prec_top20",
        (F.col("prec_top20") / base).alias("lift_top20"),
    )


def roc_curve(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """One point per threshold; the curve starts at (0, 0), which needs no row."""
    negatives = _double("n_upto") - _double("pos_upto")
    all_neg = _double("n_upto_total") - _double("pos_upto_total")
    return score_blocks(scored, slices).select(
        F.col("score").alias("threshold"),
        (negatives / F.nullif(all_neg, F.lit(0.0))).alias("fpr"),
        (_double("pos_upto") / F.nullif(_double("pos_upto_total"), F.lit(0.0))).alias("tpr"),
    )


def pr_curve(scored: DataFrame, slices: int | None = None) -> DataFrame:
    """Precision and recall at each threshold; the end point (recall 0, precision 1) needs no row."""
    return score_blocks(scored, slices).select(
        F.col("score").alias("threshold"),
        (_double("pos_upto") / _double("n_upto")).alias("precision"),
        (_double("pos_upto") / F.nullif(_double("pos_upto_total"), F.lit(0.0))).alias("recall"),
    )
