"""Model preparation at sizes that a small table does not reach."""

from __future__ import annotations

from wayfare.operators.model import _one_hot


def test_more_than_ten_thousand_levels(spark):
    rows = spark.createDataFrame([(0.0,), (11_999.0,), (12_000.0,)], "level_index double")
    vectors = {r["level_index"]: r["level_vector"] for r in _one_hot(rows, 12_000).collect()}
    assert vectors[0.0].size == 12_000 and vectors[0.0].indices.tolist() == [0]
    assert vectors[11_999.0].indices.tolist() == [11_999]
    assert vectors[12_000.0].indices.tolist() == []  # a category unseen in training


def test_whole_curves(spark, sf_dir):
    from wayfare.operators import product, search
    from wayfare.plans.warehouse import of_driver_tables

    tables = of_driver_tables(spark, sf_dir)
    products = tables["fct_product_performance"]
    assert product.lorenz_curve(products, step=None).count() == products.count()
    searches = tables["stg_search"]
    assert search.position_curve(searches, None).count() >= search.position_curve(searches).count()


def test_each_fit_from_its_own_scores(spark, sf_dir):
    from wayfare.operators import model
    from wayfare.plans.queries import QUERIES
    from wayfare.plans.warehouse import of_driver_tables

    tables = of_driver_tables(spark, sf_dir)
    rows, fitted = tables["model_rows"], tables.fitted("logistic")
    assert tables.fitted("logistic") is fitted
    assert tables["logistic_scores"].count() == rows.count()
    assert {r["model"] for r in QUERIES["fit_logistic"](spark, sf_dir).collect()} == {"Logistic regression"}
    moments = model.logistic_moments(rows, fitted).collect()
    assert [r["feature"] for r in moments] == model.NUMERIC and all(r["met"] for r in moments)
    # A fit with another objective has the same moments of the labels, but does not meet them.
    other = model.logistic_moments(rows, model.fit_logistic(rows, balanced=False)).collect()
    assert [r["moment"] for r in other] == [r["moment"] for r in moments] and not all(r["met"] for r in other)


def test_entry_is_the_first_event_not_the_smallest_hour(spark):
    from wayfare.operators.funnel import by_entry_hour
    from wayfare.operators.marts import entry_context

    events = [("a", 1, 6, 23), ("a", 2, 0, 0), ("b", 1, 2, 9), ("b", 2, 2, 10)]
    staged = spark.createDataFrame(events, "session_id_hash string, event_seq long, day_of_week long, hour_of_day long")
    assert sorted(tuple(r) for r in entry_context(staged).collect()) == [("a", 6, 23), ("b", 2, 9)]
    sessions = [("a", 0, True), ("b", 9, False)]
    facts = spark.createDataFrame(sessions, "session_id_hash string, hour_of_day long, reached_purchase boolean")
    found = {r["entry_hour"]: (r["sessions"], r["moved"]) for r in by_entry_hour(facts, staged).collect()}
    assert found == {23: (1, 1), 9: (1, 0)}
    assert entry_context(staged.limit(0)).count() == 0
