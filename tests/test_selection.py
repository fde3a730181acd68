"""Selected quantiles against sorted lists; reports from cells against reports from sessions."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_plans import exchanges, plan

from wayfare.operators import cells, funnel
from wayfare.operators.selection import quantiles_by_group
from wayfare.plans.reports import REPORTS
from wayfare.plans.warehouse import of_driver_tables

PROBS = {"least": 0.0, "low": 0.05, "mid": 0.5, "p95": 0.95, "most": 1.0}


def expected(values: list[float], q: float) -> float:
    held = sorted(values)
    place = (len(held) - 1) * q
    low, high = held[math.floor(place)], held[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("bins", [16, 1024])
def test_quantiles_of_many_shapes(spark, bins):
    rng = random.Random(bins)
    shapes = {
        "uniform": [rng.random() for _ in range(700)],
        "steep": [math.ldexp(rng.random(), rng.randrange(-900, 900)) * rng.choice((-1, 1)) for _ in range(300)],
        "hot": [7.0] * 500 + [rng.randrange(5) * 1.0 for _ in range(300)],
        "one": [3.25],
        "two": [-1.0, 1e308],
        "widest": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
        "close": [1.0 + k * 2.0**-52 for k in range(50)],
        "infinite": [float("inf")] * 3 + [float("-inf")] * 2 + [1.0, 2.0],
        "only infinite": [float("inf")] * 4,
    }
    made = [(g, v) for g, held in shapes.items() for v in held]
    made += [("uniform", None), ("uniform", float("nan")), (None, 1.0), ("empty", None)]
    rng.shuffle(made)
    table = spark.createDataFrame(made, "kind string, x double").repartition(5)
    found = {r["kind"]: r for r in quantiles_by_group(table, "kind", "x", PROBS, bins).collect()}
    assert set(found) == set(shapes)
    for g, held in shapes.items():
        for name, q in PROBS.items():
            assert found[g][name] == expected(held, q), (g, name)


def test_no_values_give_no_rows(spark):
    out = quantiles_by_group(spark.createDataFrame([], "k string, x long"), "k", "x", {"m": 0.5})
    assert out.count() == 0 and out.columns == ["k", "m"]


@pytest.fixture(scope="module")
def warehouse(spark, sf_dir):
    return of_driver_tables(spark, sf_dir)


def test_cells_are_one_plain_grouping(warehouse):
    made = cells.session_cells(warehouse["fct_session"])
    assert len(exchanges(made)) == 1 and "Expand" not in plan(made)
    table = warehouse["session_cells"]
    assert table.agg(F.sum("n_sessions")).first()[0] == warehouse["fct_session"].count()


def test_reports_read_cells_and_equal_those_over_sessions(warehouse):
    sessions = warehouse["fct_session"]
    for name, (operator, needs) in REPORTS["funnel"].items():
        assert needs[0] == "session_cells", name
        found = operator(*[warehouse[t] for t in needs])
        assert "session_start" not in plan(found) and "session_id_hash" not in plan(found), name
        assert rows(found) == rows(operator(sessions)), name


def test_reports_of_no_sessions(warehouse):
    none = warehouse["fct_session"].limit(0)
    for name, (operator, _) in REPORTS["funnel"].items():
        assert rows(operator(none)) == rows(operator(*[cells.session_cells(none), funnel.session_medians(none)][: len(REPORTS["funnel"][name][1])])), name
    assert funnel.overview(none).first()["attained"] == 0
