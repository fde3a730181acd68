"""The models side by side: the test rows are scored once, metrics, curves and findings are read from the scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import metrics, model
from wayfare.operators.findings import as_findings
from wayfare.session import written

BASELINE, LOGISTIC, BOOSTING = "Baseline", "Logistic regression", "Gradient boosting"
HONEST = [LOGISTIC, BOOSTING]
LEAKY = [model.WITH_TOTAL, model.WITHOUT_TOTAL]
MODELS = [BASELINE, *HONEST, *LEAKY]


def model_scores(
    carts: DataFrame, logistic: DataFrame, boosting: DataFrame, leaky: DataFrame, slices: int | None = None
) -> DataFrame:
    """(model, label, score) of the test rows under each model."""
    scored = {
        BASELINE: model.baseline_scores(carts, slices),
        LOGISTIC: model.tested(logistic),
        BOOSTING: model.tested(boosting),
    }
    honest = [df.select(F.lit(name).alias("model"), "label", "score") for name, df in scored.items()]
    return reduce(DataFrame.unionByName, [*honest, leaky])


def of_fit(scores: DataFrame, name: str, slices: int | None = None) -> DataFrame:
    """All metrics of one fit, from its own test rows."""
    return metrics.evaluate(model.tested(scores), name, slices)


def compared(scores: DataFrame, slices: int | None = None) -> DataFrame:
    """All metrics, one row per model; `best` marks the honest model with the highest PR-AUC, ties by name."""
    rows = [metrics.evaluate(scores.filter(F.col("model") == name), name, slices) for name in MODELS]
    table = written(reduce(DataFrame.unionByName, rows), "comparison")
    honest = table.filter(F.col("model").isin(HONEST))
    best = honest.agg(F.max_by("model", F.struct("pr_auc", "model")).alias("best"))
    return table.withColumn("best", F.col("model") == best.scalar())


def curves(scores: DataFrame, slices: int | None = None) -> DataFrame:
    """(model, curve, threshold, x, y): ROC (fpr, tpr) and PR (recall, precision) of the four fitted models."""
    parts = []
    for name in (*HONEST, *LEAKY):
        of_model = scores.filter(F.col("model") == name)
        for curve, points, x, y in (
            ("roc", metrics.roc_curve(of_model, slices), "fpr", "tpr"),
            ("pr", metrics.pr_curve(of_model, slices), "recall", "precision"),
        ):
            marks = F.lit(name).alias("model"), F.lit(curve).alias("curve")
            parts.append(points.select(*marks, "threshold", F.col(x).alias("x"), F.col(y).alias("y")))
    return reduce(DataFrame.unionByName, parts)


def model_findings(table: DataFrame) -> DataFrame:
    """What the comparison says, from its measured rows."""

    def of(condition, column: str):
        return F.max(F.when(condition, F.col(column)))

    best, total, rest = F.col("best"), F.col("model") == model.WITH_TOTAL, F.col("model") == model.WITHOUT_TOTAL
    row = table.agg(
        *[of(best, c).alias(c) for c in ("base_rate", "pr_auc", "roc_auc", "lift_top10")],
        of(total, "roc_auc").alias("with_total"),
        of(rest, "roc_auc").alias("without_total"),
    )
    rules = [
        ("note", "best_model", F.col("pr_auc"), F.col("base_rate"), "PR-AUC of the best model; against the base rate"),
        ("note", "best_tenth", F.col("lift_top10"), F.lit(1.0), "lift in the best tenth of its scores; against chance"),
        ("blocker", "label_given_away", F.col("with_total"), F.col("roc_auc"),
         "ROC-AUC with whole-session features, whose total gives the label away; against the best model"),
        ("blocker", "event_total_removed", F.col("without_total"), F.col("with_total"),
         "ROC-AUC after removing the event total alone; against the one with it"),
        ("handle", "weak_signal", F.col("roc_auc"), F.lit(0.5),
         "ROC-AUC from aggregates before the cart, which carry no order of events; against chance"),
    ]
    return as_findings(row, rules)


def check_models(table: DataFrame) -> DataFrame:
    """What must hold of the comparison whatever the optimizer's digits are: sizes, positives, ranges."""
    within = [F.col(c).between(0.0, 1.0) for c in ("roc_auc", "pr_auc", "brier", "prec_top10", "prec_top20")]
    positives = F.round(F.col("n_rows") * F.col("base_rate")).cast("bigint").alias("positives")
    in_range = F.coalesce(reduce(lambda a, b: a & b, within), F.lit(False)).alias("in_range")
    return table.select("model", "n_rows", positives, in_range)
