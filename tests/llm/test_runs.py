"""Runs of repeated windows are listed by their ends: memory follows the table of cells, not eight bytes for each."""

from __future__ import annotations

import tracemalloc

import numpy as np

from wayfare.llm.substring_dedup import runs_of


def test_runs_give_the_table_back():
    rng = np.random.default_rng(0)
    for shape in ((0, 5), (1, 1), (300, 17)):
        for share in (0, 0.1, 0.5, 1):
            marked = rng.random(shape) < share
            back = np.zeros_like(marked)
            runs = list(zip(*runs_of(marked)))
            for row, first, size in runs:
                back[row, first : first + size] = True
            assert (back == marked).all()
            assert all(first == 0 or not marked[row, first - 1] for row, first, _ in runs)


def test_a_full_table_takes_little_memory():
    marked = np.ones((20_000, 161), dtype=bool)
    tracemalloc.start()
    runs_of(marked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * marked.nbytes
