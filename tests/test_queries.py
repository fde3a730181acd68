"""Every registered query against its independent SQL on the same tables."""

from __future__ import annotations

import pytest
from compare import compare

import __spark_entry__ as contract
from wayfare.plans.oracles import ORACLES
from wayfare.plans.queries import QUERIES

FITS = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


def test_only_fits_have_no_sql():
    assert FITS == ["fit_gbt", "fit_logistic", "fitted_curves", "leakage_demo", "model_comparison", "model_findings"]


def test_comparison_sees_a_wrong_value(spark, duck, sf_dir):
    wrong = ORACLES["dq_volume"].replace("count(*) AS n_rows", "count(*) + 1 AS n_rows")
    assert compare(QUERIES["dq_volume"](spark, sf_dir), duck, wrong)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 4


def test_leak_is_visible(spark, sf_dir):
    """Whole-session features with the event total rank purchases almost perfectly; without it, less."""
    found = {r["model"]: r["roc_auc"] for r in QUERIES["leakage_demo"](spark, sf_dir).collect()}
    assert found["Leaky, with the event total"] > 0.99
    assert found["Leaky, total removed"] < found["Leaky, with the event total"]


@pytest.mark.parametrize("name", ["fit_logistic", "fit_gbt"])
def test_honest_models_score_the_test_rows(spark, sf_dir, name):
    row = QUERIES[name](spark, sf_dir).first()
    carts = QUERIES["temporal_split"](spark, sf_dir)
    assert row["n_rows"] == carts.filter("not is_train").count()
    assert 0.0 <= row["roc_auc"] <= 1.0 and 0.0 <= row["brier"] <= 1.0


def test_comparison_curves_and_findings(spark, sf_dir):
    table = {r["model"]: r for r in QUERIES["model_comparison"](spark, sf_dir).collect()}
    best = [name for name, r in table.items() if r["best"]]
    honest = ("Logistic regression", "Gradient boosting")
    assert len(table) == 5 and len(best) == 1 and best[0] in honest
    assert table[best[0]]["pr_auc"] == max(table[name]["pr_auc"] for name in honest)

    found = {r["finding"]: r for r in QUERIES["model_findings"](spark, sf_dir).collect()}
    assert found["best_model"]["value"] == table[best[0]]["pr_auc"]
    assert found["label_given_away"]["value"] == table["Leaky, with the event total"]["roc_auc"]
    assert found["label_given_away"]["against"] == table[best[0]]["roc_auc"]

    points = QUERIES["fitted_curves"](spark, sf_dir).collect()
    assert {(p["model"], p["curve"]) for p in points} == {(m, c) for m in table if m != "Baseline" for c in ("roc", "pr")}
    for name in table.keys() - {"Baseline"}:  # the area under the points, from (0, 0) on, is the published ROC-AUC
        line = sorted([(0.0, 0.0), *((p["x"], p["y"]) for p in points if p["model"] == name and p["curve"] == "roc")])
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(line, line[1:]))
        assert area == pytest.approx(table[name]["roc_auc"])
