"""Hard negatives against brute force and SQL."""

from __future__ import annotations

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from compare import compare, connect  # noqa: E402

from wayfare.llm import hard_negatives, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score int, shard long"


def expected(rows):
    held = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        c = [math.floor(256 * v) for v in x]
        if sum(v * v for v in c) >= 1 << 62:
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, c)
        held[vec_id] = min(held.get(vec_id, row), row)
    out = []
    for a, (label, c) in held.items():
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(c, d)), b, m == label) for b, (m, d) in held.items() if b != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [(t, b) for t, b, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(fits)]
    return sorted(out)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def test_equal_to_sql_and_brute_force(spark, sf_dir):
    found = queries.op12_lemp_negatives(spark, sf_dir)
    assert compare(found, connect(sf_dir), queries.ORACLES["op12_lemp_negatives"]) == []
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(found) == expected(rows) and len(expected(rows)) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_of_many_lengths(spark, seed):
    """Lengths from tiny to huge, clusters that the ranges can prune, many ties."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(700):
        x = rng.normal(size=6) * rng.choice([0.01, 1, 30]) if i % 3 else np.eye(6)[i % 6] * (1 + i % 4) + rng.normal(size=6) * 0.02
        rows.append((i * (10 if i % 5 == 0 else 1), [float(v) for v in x], int(i % 4)))
    rows += [(100_000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(120)]
    found = hard_negatives.mine(table(spark, rows), shard_rows=150, bucket_rows=40)
    assert result(found) == expected(rows)


def test_candidates_hold_all_that_reach_the_bound_and_fewer_rows():
    rng = np.random.default_rng(5)
    rows = np.rint(np.concatenate([np.eye(8)[rng.integers(0, 8, 400)] * 200 + rng.normal(size=(400, 8)) * 9, rng.normal(size=(100, 8)) * 99])).astype(np.int64)
    bucket = hard_negatives.Bucket.of(np.arange(500), np.zeros(500, np.int64), rows)
    pruned = 0
    for _ in range(300):
        anchor = rows[rng.integers(0, 500)]
        length, focus = float(np.sqrt((anchor**2).sum())), np.argsort(-np.abs(anchor), kind="stable")[:4]
        exact = rows @ anchor
        least = int(np.sort(exact)[-rng.integers(1, 60)])
        places = bucket.candidates(anchor, length, focus, least)
        held = np.arange(500)[places] if places is not None else np.zeros(0, int)
        assert set(np.flatnonzero(exact >= least)) <= set(held.tolist()) and len(set(held.tolist())) == len(held)
        assert (bucket.scores(places, anchor, length) == exact[held]).all()
        pruned += len(held) < 250
    assert pruned > 100


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(201)]
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (301, [1.0, None, 1.0, 1.0], 1), (302, [float("nan")] * 4, 0), (303, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(304, [1.0] * 4, None), (400, [], 1), (500, [0.0] * 4, 0), (305, [1.0, 2.0], 1), (600, [1.0, 2.0, 0.5, 0.1, 3.0], 0), (306, [1e300] * 4, 1)]
    rows += [(0, [2.0] * 4, 1), (0, [2.0] * 4, 1), (700, [1e6] * 4, 1), (701, [1e6] * 4, 1), (702, [8e5] * 4, 0)]
    assert result(hard_negatives.mine(table(spark, rows), shard_rows=60, bucket_rows=16)) == expected(rows)
    assert result(hard_negatives.mine(table(spark, rows).limit(0))) == []
    one_label = [(i, x, 3) for i, x, _ in rows if i is not None and i % 7]
    assert result(hard_negatives.mine(table(spark, one_label))) == []
