"""Alignment of two tokenizers against whole texts encoded by the libraries, pair by pair."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from functools import reduce
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from wayfare.llm import alignment, queries  # noqa: E402
from wayfare.llm.tokens import byte_alphabet  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "one", "one", "a  b\t c\r\nd \n\n e", " lead", "trail \n ", "naïve ﬁ ß 中文 x", "x▁y z", "a\x00b \x1c c\x85d"]
ODD += ["<|endoftext|> </s> <0x41> <s>", "it's we'll 12a3b 'sabc", "é" * 50 + " " + "中" * 70, "ab1" * 300, "　 wide nb", " " * 40 + "end", "\ta", "x\n\n\n\ny"]
ODD += ["a, b. c,d e., f1, é, g.\n,h .i,\tj,\n k,", ",", ".a", "x,\u2028y. "]
ODD += ["word " * 400 + "12ab34\nnew line " * 30, "é中" * 300 + "a1" * 200]


def library(text):
    """A ids, B ids and their byte ends by the libraries, or nothing."""
    a_tool, b_tool = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_tool.encode_special_tokens = True
    return a_tool, b_tool


A_TOOL, B_TOOL = library("")
TOKEN = {i: t for t, i in A_TOOL.get_vocab().items()}


def encoded(text):
    if not text:
        return None
    alphabet = {c: b for b, c in byte_alphabet().items()}
    a, b = A_TOOL.encode(" " + text, add_special_tokens=False).ids, B_TOOL.encode(text)
    one = [bytes(alphabet[c] for c in TOKEN[i]) for i in a]
    two = [bytes([int(B_TOOL.id_to_piece(i)[3:5], 16)]) if B_TOOL.is_byte(i) else B_TOOL.id_to_piece(i).replace("▁", " ").encode() for i in b]
    data = (" " + text).encode()
    if b"".join(one) != data or b"".join(two) != data:
        return None
    return a, np.cumsum([len(x) for x in one]).tolist(), b, np.cumsum([len(x) for x in two]).tolist()


def groups_of(text):
    found = encoded(text)
    if found is None:
        return []
    a, a_ends, b, b_ends = found
    out, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def expected(rows):
    groups = [groups_of(t) for _, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    counts = Counter(pair for held in links for pair in held)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), g, held in zip(rows, groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for (a, b), n in held.items() if counts[a, b] == most[a])
        sums = (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(held.values()), best, sum(n * counts[p] for p, n in held.items()))
        out.append((doc_id, *sums, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def result(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert df.columns == names
    return sorted([tuple(r) for r in df.collect()], key=repr)


def texts(groups):
    tool = alignment.tokens(*PATHS)
    return groups.texts(tool.written, len(tool.bytes_a), np.arange(len(groups)))


def same(x, y):
    def flat(f):
        return [*map(list, f.head), *map(list, f.tail), f.cut, *(t for g in f.closed for t in texts(g)), *(e for g in f.closed for e in g.ends.tolist())]

    return flat(x) == flat(y)


def test_composition_is_associative_and_gives_the_groups():
    rng = random.Random(4)
    for text in [t for t in ODD if encoded(t)] * 6:
        a, a_ends, b, b_ends = (np.array(x, np.int64) for x in encoded(text))
        n = rng.randrange(1, 7)
        x = [0, *sorted(rng.randrange(len(a) + 1) for _ in range(n)), len(a)]
        y = [0, *sorted(rng.randrange(len(b) + 1) for _ in range(n)), len(b)]
        parts = [alignment.fragment(a[p:q], a_ends[p:q], b[r:s], b_ends[r:s]) for p, q, r, s in zip(x, x[1:], y, y[1:])]
        left = reduce(alignment.compose, parts, alignment.Fragment())
        right = reduce(lambda u, v: alignment.compose(v, u), reversed(parts), alignment.Fragment())
        k = rng.randrange(len(parts) + 1)
        split = alignment.compose(reduce(alignment.compose, parts[:k], alignment.Fragment()), reduce(alignment.compose, parts[k:], alignment.Fragment()))
        assert same(left, right) and same(left, split)
        closed = [t for g in [*alignment.whole(left.head), *left.closed] for t in texts(g)]
        assert closed == [(",".join(map(str, p)) + "|" + ",".join(map(str, q))).encode() for p, q in groups_of(text)]


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op11_fragment_alignment(spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("chunk,fan,hot_pairs", [(1 << 16, 16, 1_000_000), (7, 2, 10), (60, 3, 1), (300, 16, 40)])
def test_odd_texts_in_chunks_of_all_sizes(spark, monkeypatch, chunk, fan, hot_pairs):
    """Short chunks cut inside runs without white space, where only one tokenizer can be cut."""
    monkeypatch.setattr(alignment, "TEXTS", 4)
    rows = [(k if k != 3 else None, t) for k, t in enumerate(ODD)] + [(99, ODD[-1]), (99, ODD[-1])]
    table = spark.createDataFrame([(i, t, 1, "q", 2.0) for i, t in rows], "doc_id long, text string, row int, PAIRS string, n double")
    found = alignment.align(table.repartition(3), *PATHS, chunk=chunk, fan=fan, hot_pairs=hot_pairs)
    assert result(found) == expected(rows)


def test_empty_table(spark):
    assert result(alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS)) == []


def test_big_groups_are_counted_before_they_are_multiplied(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 7, 50)
    groups = alignment.Groups(a, b, np.array([20, 60]), np.array([30, 50]), np.array([100, 200]))
    plain = groups.links(7, np.array([4, 4]))
    monkeypatch.setattr(alignment, "BIG_GROUP", 10)
    counted = groups.links(7, np.array([4, 4]))
    assert all((x == y).all() for x, y in zip(plain, counted)) and plain[2].sum() == 20 * 30 + 40 * 20
