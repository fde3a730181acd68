"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get the log-odds of toxic against other labelled texts with a Dirichlet prior taken from all of them; a token
whose log-odds are no clear evidence counts as zero, and every token pays a small price, so ordinary text has a
negative drift. A linear scan finds all maximal scoring segments of a text. How often chance gives a segment of a
score is an extreme-value law, K * n * exp(-lambda * score) for n tokens, fitted on labelled clean texts; the
evidence of a document is the sum of -log of that number over its significant segments, and a logistic curve turns it
into a probability. The token counts and the curve are fitted on different rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import id_remainder, mapped, slices
from wayfare.session import written

MAX_LABELLED = 40_000  # labelled rows the classifier is fitted on; chosen by a hash of the id, so spread evenly
PRIOR = 0.01  # weight of the prior, as a share of all counts
PREFIXES = range(4, 9)  # letters of the word beginnings that count as tokens too, written with a hyphen
CACHED_WORDS = 500_000  # looked-up words that a worker keeps; forgotten when full
CLEAR = 3.0  # log-odds count from so many standard deviations on
PRICE = 0.5  # what every token costs
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    often: float = 1e-3  # K
    slope: float = 1.0
    offset: float = -3.0


class Lookup(dict):
    """The score of a word: its own, else that of its longest scored beginning, else None."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores

    def __missing__(self, word: str) -> float | None:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self.scores.get(word)
        for k in reversed(PREFIXES):
            if found is None and len(word) > k:
                found = self.scores.get(word[:k] + "-")
        self[word] = found
        return found


def segments(text: str | None, scores: Lookup) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and all maximal scoring segments (first token, token after the last, score).

    Between two tokens with a positive score the sum falls by what lies there, so only those tokens are visited.
    """
    tokens = TOKEN.findall(text.lower()) if text else []
    held: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum after
    total, last = 0.0, 0
    for at, value in [(k, v) for k, t in enumerate(tokens) if (v := scores[t]) is not None]:
        total -= PRICE * (at - last)
        last = at + 1
        gain = value - PRICE
        before, total = total, total + gain
        if gain <= 0:
            continue
        start, stop = at, at + 1
        low, high = before, total
        while True:  # join with earlier segments as long as that raises the sum
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j -= 1
            if j < 0 or held[j][3] >= high:
                held.append((start, stop, low, high))
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return len(tokens), [(a, b, high - low) for a, b, low, high in held]


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    """Sum of -ln(expected number of such segments by chance) over the segments where that is below one."""
    base = math.log(max(model.often * max(n, 1), 1e-12))
    return sum(max(0.0, model.rate * s - base) for _, _, s in found)


def probability(model: Model, x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.offset))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below zero) and offset by Newton's method with a weak prior."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def _token_counts(rows: DataFrame) -> DataFrame:
    """(token, c1, c0): in how many toxic and other rows a word or a word's beginning occurs.

    A row that repeats a word is one witness.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            names = list(seen[0].keys() | seen[1].keys())
            out = pd.DataFrame({"token": names, "c1": [seen[1][t] for t in names], "c0": [seen[0][t] for t in names]})
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in slices(batches):
            for text, toxic in zip(batch["text"].tolist(), batch["toxic"].tolist()):
                words = set(TOKEN.findall((text or "").lower()))
                words |= {w[:k] + "-" for w in words for k in PREFIXES if len(w) > k}
                seen[int(toxic)].update(words)
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush()
        yield flush()

    parts = mapped(rows.select("text", "toxic"), count, "token string, c1 long, c0 long")
    return parts.groupBy("token").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def token_scores(counts: DataFrame) -> dict[str, float]:
    """Log-odds with a Dirichlet prior for the tokens with clear evidence in the labelled sample."""
    total = counts.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).first()
    n1, n0 = float(total["n1"] or 0), float(total["n0"] or 0)
    if not n1 or not n0:
        return {}
    prior, weight = PRIOR * (F.col("c1") + F.col("c0")), PRIOR * (n1 + n0)
    a, b = F.col("c1") + prior, F.col("c0") + prior
    odds = F.log(a / (n1 + weight - a)) - F.log(b / (n0 + weight - b))
    clear = counts.select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    rows = clear.filter(F.col("z") >= CLEAR).collect()  # tokens of at most MAX_LABELLED texts
    return {r["token"]: float(r["odds"]) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> Model:
    """Fit on labelled rows whose crc32(doc_id) modulo `modulus` is not `held`. Without labels the model is flat."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(id_remainder(F.col("doc_id"), modulus) != held)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # an id that is repeated is one row
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(10))
    rows = written(rows.withColumn("toxic", F.least(F.col("toxic"), F.lit(1))).withColumn("fold", fold), "labelled")
    model = Model(scores=token_scores(_token_counts(rows.filter("fold < 7"))))
    scores = model.scores

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = Lookup(scores)
        for batch in slices(batches):
            found = [segments(x, lookup) for x in batch["text"].tolist()]
            yield pd.DataFrame(
                {"toxic": batch["toxic"].to_numpy(), "n": [x[0] for x in found], "s": [[y[2] for y in x[1]] for x in found]}
            )

    # At most MAX_LABELLED * 0.3 rows, each with the scores of its segments.
    held_back = mapped(rows.filter("fold >= 7").select("text", "toxic"), measure, "toxic int, n long, s array<double>").collect()
    clean = [r for r in held_back if not r["toxic"]]
    by_chance = [s for r in clean for s in r["s"]]
    model.rate = 1.0 / max(0.25, float(np.mean(by_chance)) if by_chance else 1.0)
    model.often = (len(by_chance) + 0.5) / (sum(r["n"] for r in clean) + 1.0)
    x = np.array([evidence(model, r["n"], [(0, 0, s) for s in r["s"]]) for r in held_back])
    y = np.array([r["toxic"] for r in held_back], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        model.slope, model.offset = _logistic(np.log1p(x), y)
    elif len(y):
        model.slope, model.offset = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return model


def score(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2, threshold: float = 0.3, passages: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (and the significant passages).

    Null and empty texts have no evidence and get the curve's lowest score. Each row is scored alone, so repeated
    rows get equal scores; an empty table gives no rows. Only doc_id and text are read.
    """
    let = docs.sparkSession.sparkContext.broadcast(model)  # its tokens come from at most MAX_LABELLED texts

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = let.value
        lookup = Lookup(m.scores)
        for batch in slices(batches):
            values, spans = [], []
            for text in batch["text"].tolist():
                n, found = segments(text, lookup)
                values.append(probability(m, math.log1p(evidence(m, n, found))))
                if passages:
                    limit = math.log(max(m.often * max(n, 1), 1e-12)) / m.rate
                    spans.append([{"start": a, "stop": b, "score": s} for a, b, s in found if s > limit])
            out = batch[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["score"] = values
            out["predicted"] = [int(v >= threshold) for v in values]
            if passages:
                out["passages"] = spans
            yield out

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_remainder(F.col("doc_id").cast("long"), modulus) == held).alias("held_out"),
        "text",
    )
    schema = "doc_id long, held_out boolean, score double, predicted int"
    schema += ", passages array<struct<start: long, stop: long, score: double>>" * passages
    return mapped(rows, judge, schema)
