"""Repeated passages against brute force, and the index against plain search."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from wayfare.llm import passages, queries  # noqa: E402
from wayfare.llm.fm_index import FmIndex, WaveletTree  # noqa: E402

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "x " * 300), (None, "x " * 300), (5, "y " * 500)]
ODD += [(6, "y " * 120 + "end"), (7, "naïve Ünïcode ﬁ\x1c ß\x85中文 " * 20), (8, "naïve Ünïcode ﬁ\x1c ß\x85中文 " * 21)]


def expected(rows, length):
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    least = {}
    for i, words in zip(ids, split):
        for k in range(len(words) - length + 1):
            stretch = tuple(words[k : k + length])
            least[stretch] = min(least.get(stretch, i), i)
    out = []
    for (doc_id, _), i, words in zip(rows, ids, split):
        gone = set()
        for k in range(len(words) - length + 1):
            if least[tuple(words[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()], key=repr)


def test_ranks_in_the_wavelet_tree():
    rng = np.random.default_rng(3)
    for n_symbols in (1, 2, 3, 17):
        symbols = rng.integers(0, n_symbols, 200)
        tree = WaveletTree(symbols, n_symbols)
        for c in range(n_symbols):
            at = np.arange(201)
            assert tree.rank(np.full(201, c), at).tolist() == [int((symbols[:k] == c).sum()) for k in at]


def test_index_finds_every_stretch_of_streamed_sequences():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n_words, length = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        held = [rng.integers(0, n_words, rng.integers(0, 15)) for _ in range(rng.integers(1, 8))]
        owners = rng.integers(0, 100, len(held))
        asked = [rng.integers(0, n_words + 1, rng.integers(0, 20)) for _ in range(rng.integers(1, 9))]
        least = {}
        for owner, x in zip(owners, held):
            for k in range(len(x) - length + 1):
                least[tuple(x[k : k + length])] = min(least.get(tuple(x[k : k + length]), 1000), owner)
        want, at = {}, 0
        for x in asked:
            want |= {at + k: least[tuple(x[k : k + length])] for k in range(len(x) - length + 1) if tuple(x[k : k + length]) in least}
            at += len(x)
        flat = [(np.concatenate(x).astype(np.uint64), np.array([len(y) for y in x])) for x in (held, asked)]
        place, found = FmIndex(*flat[0], owners, length).stretches(*flat[1])
        assert len(place) == len(want) and dict(zip(place.tolist(), found.tolist())) == want


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows, 50)
    assert sum(x[2] for x in want) > 1000
    assert result(queries.op13_fm_passages(spark, sf_dir)) == want


@pytest.mark.parametrize("hot_runs,shard_words", [(10_000, 1 << 20), (10_000, 60), (2, 500), (0, 500)])
def test_few_words_and_small_shards(spark, hot_runs, shard_words):
    """Texts of few different words, cut and pasted among one another; all ways through the shards."""
    rng = random.Random(hot_runs + shard_words)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice((3, 20, 90))))) for i in range(40)]
    for i in range(40):
        part = rows[rng.randrange(40)][1]
        rows.append((rng.randrange(60), " ".join(rng.choice("abcd") for _ in range(9)) + " " + part[rng.randrange(20) :]))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length, gram in ((6, 2), (9, 8), (5, 8)):
        found = passages.dedup_passages(table, length, gram, hot_runs, shard_words)
        assert result(found) == expected(rows, length)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_WORDS", 50)
    rows = [(i, t, 1, "x", None) for i, t in ODD]
    table = spark.createDataFrame(rows, "doc_id long, text string, ord int, KEY string, spans string").repartition(3)
    assert result(passages.dedup_passages(table)) == expected(ODD, 50)
    empty = passages.dedup_passages(table.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    texts = passages.dedup_passages(table, with_text=True).collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in texts)
