"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Common words are sorted into classes by the company
they keep; inside a class a Huffman tree with up to WIDTH branches a node leads to the word. All other words, unseen ones
included, are one class whose tree leads to LEAVES leaves, to which a checksum deals them; only inside a leaf they share
its probability by their smoothed counts. The choice of the class and that at every node is a softmax with hashed features
of the node and the history: the word before (bigram), the word before that (skip), and both (trigram). So every token has
a proper probability that depends on its history, and the vocabulary is never cut.

Counts are a Spark aggregate over all training texts. Weights are trained by distributed gradient updates: in each
round every task runs minibatch steps over its share of the texts from the weights of the round before, and the
changes are averaged row by row, weighted by how often a task has used the row. Scoring reads encoded texts in
numpy batches. The driver and the tasks hold the counts of words above a fixed share of all tokens (at most 1 / share
words) and the weights; counts of rarer words are joined.

The model grows with the counted training tokens: feature rows and words with classes with their cube root, and so do
the tokens of a training task. The tables that tasks send are then a fixed share of the input at every size.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import id_remainder, mapped, numbered, slices
from wayfare.session import written

HEAD_SHARE = 5e-6  # words with at least this share of all tokens are known to every task: 200,000 words at most
IN_CLASSES = 8_000  # of those, the most frequent ones are sorted into classes; so many up to UNIT tokens
CLASSES = 22
WIDTH = CLASSES + 2  # branches of a node; at the root the classes, the end and the other words
LEAVES = WIDTH * WIDTH  # of the words without a place
CONTEXTS = 128  # hashed neighbours that describe a word's company
ROWS = 1 << 15  # hashed feature rows up to UNIT tokens
UNIT = 1 << 24  # training tokens above which the model grows
BATCH = 8_192  # tokens in a gradient step up to UNIT tokens: each step passes over all feature rows
ROUNDS = 2  # each over half of the training texts
RATE = 0.35
BLOCKS = 32  # parts in which weights travel, up to UNIT tokens
PER_TASK = 1 << 21  # tokens of a training task up to UNIT tokens
END = ""  # the token that ends a text


@dataclass
class Vocabulary:
    """Counts of the head, places of the words that have classes, and totals over all training tokens."""

    counts: dict[str, int]
    place: dict[str, int]  # the end token is place 0
    tokens: int
    types: int

    @property
    def growth(self) -> float:
        """Factor of the model's sizes."""
        return max(1.0, (self.tokens / UNIT) ** (1 / 3))

    @property
    def feature_rows(self) -> int:
        return math.ceil(ROWS * self.growth)

    @property
    def batch(self) -> int:
        return math.ceil(BATCH * self.growth)

    @property
    def blocks(self) -> int:
        return math.ceil(BLOCKS * self.growth)

    @property
    def tasks(self) -> int:
        return max(1, math.ceil(self.tokens / (PER_TASK * self.growth)))

    @property
    def place_type(self) -> str:
        """A place, a leaf, or the start of a text, fits into it."""
        return "<u2" if self.start < 1 << 16 else "<u4"

    @property
    def rare_place(self) -> int:
        """The place of the first leaf."""
        return len(self.place)

    @property
    def start(self) -> int:
        """Stands for what is before a text."""
        return self.rare_place + LEAVES

    @property
    def rare_tokens(self) -> int:
        return self.tokens - sum(self.counts[w] for w in self.place)


class Head:
    """Word -> its number among the words of the head and those with places; place and log10(c + 1) of each number.

    A word without a place goes to a leaf by its checksum.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        words = [*vocabulary.place, *(w for w in vocabulary.counts if w not in vocabulary.place)]
        self.rare, names = vocabulary.rare_place, [w.encode("utf-8") for w in words]
        self.number = {w: k for k, w in enumerate(names)}
        self.place = np.array([*range(self.rare), *map(self.leaf, names[self.rare:])], dtype=vocabulary.place_type)
        self.log = np.array([math.log10(vocabulary.counts[w] + 1) for w in words])

    def leaf(self, word: bytes) -> int:
        return self.rare + zlib.crc32(word) % LEAVES

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, float, float, int, Counter]:
        """Places, sum of logs, that of words without a place, the number of words of the head, and all other words."""
        number = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        inside = number >= 0
        places = np.empty(len(words), dtype=self.place.dtype)
        known, other = number[inside], [words[k] for k in np.flatnonzero(~inside).tolist()]
        places[inside] = self.place[known]
        places[~inside] = [self.leaf(w) for w in other]
        log = self.log[known]
        return places, float(log.sum()), float(log[known >= self.rare].sum()), len(known), Counter(other)


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8: only different words are ever decoded."""
    return text.encode("utf-8").lower().split() if text else []


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over all texts; every text ends with END."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("utf-8") for w in seen], "c": list(seen.values())})
            seen.clear()
            return out

        for batch in slices(batches):
            for text in batch["text"].tolist():
                seen.update(tokens_of(text))
            seen[END.encode("utf-8")] += len(batch)
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    return mapped(rows.select("text"), count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    least = max(1, math.ceil(HEAD_SHARE * n))
    head = counts.filter((F.col("c") >= least) & (F.col("c") > 1)).collect()  # at most 1 / HEAD_SHARE words
    known = {r["word"]: int(r["c"]) for r in head}
    common = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))
    common = common[: math.ceil(IN_CLASSES * Vocabulary({}, {}, n, v).growth)]
    if END not in known and n:
        known[END] = int(counts.filter(F.col("word") == END).first()["c"])
    place = {w: k for k, w in enumerate([END, *common])} if n else {}
    return Vocabulary(known, place, n, v)


def leaf_totals(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The smoothed count of every leaf: tokens and types of its words without a place, and one for unseen words."""
    leaf = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(LEAVES)).alias("leaf")
    out = np.ones(LEAVES)
    for r in counts.groupBy(leaf).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        out[r["leaf"]] += r["n"]
    for w in vocabulary.place:
        out[zlib.crc32(w.encode("utf-8")) % LEAVES] -= vocabulary.counts[w] + 1
    return out


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The texts as places, with what the head's counts say and the words that are not in the head."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = Head(shared.value)
        for batch in slices(batches):
            out = []
            for rid, doc_id, held, text in zip(*(batch[c].tolist() for c in ("row_id", "doc_id", "held_out", "text"))):
                words = tokens_of(text)
                words.append(END.encode("utf-8"))
                places, head_log, head_rare, head_known, other = head.encoded(words)
                names, times = [w.decode("utf-8") for w in other], list(other.values())
                out.append((rid, doc_id, held, len(words), head_log, head_rare, head_known, places.tobytes(), names, times))
            names = "row_id doc_id held_out n_tokens head_log head_rare head_known ids words times".split()
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = (
        "row_id long, doc_id long, held_out boolean, n_tokens long, head_log double, head_rare double, head_known long, "
        "ids binary, words array<string>, times array<long>"
    )
    return mapped(rows, encode, schema)


def _streams(
    batches: Iterator[pd.DataFrame], start: int, kind: str, size: int = 400
) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of encoded rows with all their places, the two places before each."""
    for batch in slices(batches, size):
        parts = [np.frombuffer(x, dtype=kind).astype(np.int32) for x in batch["ids"].tolist()]
        ids = np.concatenate(parts)
        first = np.cumsum([0, *[len(x) for x in parts[:-1]]])
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first] = start
        second = np.empty_like(ids)
        second[1:] = before[:-1]
        second[first] = start
        yield batch, ids, before, second


def _company(coded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """For every place, how often hashed words stand before it; one row per place and one for all leaves, summed by Spark in
    blocks."""
    rare, begin, kind, blocks = vocabulary.rare_place, vocabulary.start, vocabulary.place_type, vocabulary.blocks
    n = rare + 1
    step = -(-n // blocks)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n * CONTEXTS, dtype=np.float32)
        for _, ids, before, _ in _streams(batches, begin, kind):
            ids = np.minimum(ids, rare)
            context = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)
            total += np.bincount(ids * np.int64(CONTEXTS) + context, minlength=n * CONTEXTS)
        matrix = total.reshape(n, CONTEXTS)
        yield pd.DataFrame({"block": range(blocks), "part": [matrix[k * step : (k + 1) * step].tobytes() for k in range(blocks)]})

    return _summed(mapped(coded.select("ids").coalesce(vocabulary.tasks), gather, "block int, part binary")).reshape(-1, CONTEXTS)[:n]


def _summed(parts: DataFrame) -> np.ndarray:
    """Sum the parts of each block; a task adds one part at a time, the driver gets one sum per block."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch["block"].tolist(), batch["part"].tolist()):
                values = np.frombuffer(part, dtype=np.float32)
                sums[block] = sums[block] + values if block in sums else values.astype(np.float64)
        if sums:
            yield pd.DataFrame({"block": list(sums), "part": [x.astype(np.float32).tobytes() for x in sums.values()]})

    rows = mapped(parts.repartition("block"), add, "block int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], dtype=np.float32) for r in sorted(rows, key=lambda r: r["block"])])


def classes_of(company: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The class of every place: words by k-means on the company they keep, then the end and the leaves."""
    rare = vocabulary.rare_place
    out = np.zeros(rare + LEAVES, dtype=np.int64)
    out[0], out[rare:] = CLASSES, CLASSES + 1
    words = np.arange(1, rare)
    if len(words) <= CLASSES:
        out[words] = np.arange(len(words))
        return out
    share = np.sqrt((company[words] + 0.01) / (company[words] + 0.01).sum(axis=1, keepdims=True)).astype(np.float64)
    weight = company[words].sum(axis=1) + 1.0
    centres = share[:CLASSES].copy()  # the most frequent words
    for _ in range(12):
        near = ((centres * centres).sum(axis=1)[None, :] - 2 * share @ centres.T).argmin(axis=1)
        for k in range(CLASSES):
            mine = near == k
            if mine.any():
                centres[k] = (share[mine] * weight[mine, None]).sum(axis=0) / weight[mine].sum()
    out[words] = near
    return out


@dataclass
class Tree:
    """The nodes on the way to every place, the branch taken at each, and every node's branches without a history."""

    first: np.ndarray  # of a place's steps
    length: np.ndarray
    nodes: np.ndarray
    branches: np.ndarray
    bias: np.ndarray  # (node, branch) -> log of its share; node 0 chooses the class

    def steps(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the token of each step, its node, its branch) of tokens at the places `ids`."""
        n = self.length[ids]
        token = np.repeat(np.arange(len(ids)), n)
        ends = np.cumsum(n)
        at = np.arange(len(token)) + np.repeat(self.first[ids] - (ends - n), n)
        return token, self.nodes[at], self.branches[at]


def tree_of(classes: np.ndarray, mass: np.ndarray, rare_tokens: int) -> Tree:
    """The classes below the root, the places of each class below it in a Huffman tree of their `mass`."""
    total = np.bincount(classes, weights=mass, minlength=WIDTH) + 0.5
    total[CLASSES + 1] = rare_tokens + 0.5  # without the smoothing of the leaves
    bias = [np.log(total / total.sum())]
    paths = [[(0, int(k))] for k in classes]

    def placed(item, path: list) -> None:
        if isinstance(item, int):
            paths[item] = path
            return
        node = len(bias)
        shares = np.array([m for m, _, _ in item])
        bias.append(np.concatenate([np.log(shares / shares.sum()), np.full(WIDTH - len(item), -np.inf)]))
        for branch, (_, _, below) in enumerate(item):
            placed(below, [*path, (node, branch)])

    for k in range(WIDTH):
        heap = [(float(mass[p]), int(p), int(p)) for p in np.flatnonzero(classes == k)]
        heapq.heapify(heap)
        many, tie = 2 + (len(heap) - 2) % (WIDTH - 1), len(classes)  # so that all nodes above are full
        while len(heap) > 1:
            lightest = [heapq.heappop(heap) for _ in range(many)]
            heapq.heappush(heap, (sum(m for m, _, _ in lightest), tie, lightest))
            many, tie = WIDTH, tie + 1
        if heap:
            placed(heap[0][2], [(0, k)])
    length = np.array([len(p) for p in paths], dtype=np.int64)
    steps = np.array([step for p in paths for step in p], dtype=np.int64)
    return Tree(np.cumsum(length) - length, length, steps[:, 0], steps[:, 1], np.array(bias, dtype=np.float32))


def _features(before: np.ndarray, second: np.ndarray, node: np.ndarray, rows: int) -> list[np.ndarray]:
    a, b = before.astype(np.uint64) + np.uint64(1), second.astype(np.uint64) + np.uint64(1)
    half, size = np.uint64(32), np.uint64(rows)
    at = node.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return [
        ((x >> half) * size >> half).astype(np.int64)
        for x in (
            (a ^ at) * np.uint64(0x9E3779B97F4A7C15),
            (b ^ at) * np.uint64(0xC2B2AE3D27D4EB4F),
            (a * np.uint64(0x165667B19E3779F9) ^ b ^ at) * np.uint64(0xD6E8FEB86659FD93),
        )
    ]


def _logits(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """The summed weights of the features and the bias, (branch, step), with zero as the largest of each step."""
    # `take` is several times as fast as an index; no feature is outside, so nothing is clipped.
    z = weights.take(features[0], axis=0, mode="clip")
    for f in features[1:]:
        z += weights.take(f, axis=0, mode="clip")
    z += bias
    z = np.ascontiguousarray(z.T)  # a row per branch: all work on it is along the steps
    z -= z.max(axis=0)
    return z


def _train(
    coded: DataFrame, weights: np.ndarray, tree: Tree, vocabulary: Vocabulary, rate: float
) -> np.ndarray:
    """One round of gradient steps in every task, and the averaged weights."""
    rows_in_all, width = weights.shape
    begin, kind, blocks, batch_size = vocabulary.start, vocabulary.place_type, vocabulary.blocks, vocabulary.batch
    shared = coded.sparkSession.sparkContext.broadcast((weights, tree))
    step = -(-rows_in_all // blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, tree = shared.value
        now = start.copy()
        uses = np.zeros(rows_in_all, dtype=np.float32)
        change = np.empty((width, rows_in_all), dtype=np.float32)
        for _, ids, before, second in _streams(batches, begin, kind):
            for at in range(0, len(ids), batch_size):
                here = slice(at, at + batch_size)
                token, node, branch = tree.steps(ids[here])
                features = _features(before[here][token], second[here][token], node, rows_in_all)
                push = _logits(now, tree.bias[node], features)
                np.exp(push, out=push)
                push /= push.sum(axis=0)
                push[branch, np.arange(len(token))] -= 1.0
                every = np.concatenate(features)
                n = np.bincount(every, minlength=rows_in_all)
                # The step falls with the uses of a row, as its error does.
                size = rate / np.sqrt(np.maximum(n, 1) * (1.0 + uses / 64.0))
                for k in range(width):
                    change[k] = size * np.bincount(every, np.tile(push[k], len(features)), rows_in_all)
                now -= change.T  # in one pass over the rows
                uses += n
        delta = (now - start) * uses[:, None]
        table = np.concatenate([delta, uses[:, None]], axis=1).astype(np.float32)
        yield pd.DataFrame({"block": range(blocks), "part": [table[k * step : (k + 1) * step].tobytes() for k in range(blocks)]})

    parts = mapped(coded.select("ids").coalesce(-(-vocabulary.tasks // ROUNDS)), run, "block int, part binary")
    total = _summed(parts).reshape(rows_in_all, width + 1)
    return weights + total[:, :width] / np.maximum(total[:, width:], 1.0)


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training uses the rows whose crc32(doc_id) modulo `modulus` is not `held`. Null and empty texts are the end token
    alone. Repeated rows train as often as they occur and get equal scores. If no row trains, every token has
    probability one, as the only type there is. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text").withColumn("held_out", id_remainder(F.col("doc_id"), modulus) == held)
    counts = written(word_counts(rows.filter("not held_out")), "word-counts")
    known = vocabulary_of(counts)
    n, v, rare = known.tokens, known.types, known.rare_place
    coded = written(encoded(numbered(rows), known), "encoded")

    # Words outside the head: count, and log10(c + 1), by a join with their counts.
    tail = coded.select("row_id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row_id", "x.words", "x.times")
    tail = tail.withColumnRenamed("words", "word").join(counts, "word")
    tail = tail.groupBy("row_id").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_log")
    )

    if n:
        train = coded.filter("not held_out").select("row_id", "ids")
        of_leaf = leaf_totals(counts, known)
        mass = np.concatenate([np.array([known.counts[w] for w in known.place], dtype=np.float64), of_leaf])
        tree = tree_of(classes_of(_company(train, known), known), mass, known.rare_tokens)
        weights = np.zeros((known.feature_rows, WIDTH), dtype=np.float32)
        for k in range(ROUNDS):
            part = train.filter(F.pmod(F.xxhash64("row_id"), F.lit(ROUNDS)) == k)
            weights = _train(part, weights, tree, known, RATE / (k + 1)).astype(np.float32)
        inside = np.zeros(len(mass))  # a word of a leaf has its smoothed count of the leaf's
        inside[rare:] = -np.log(of_leaf)
        shared = spark.sparkContext.broadcast((weights, tree, inside))

    kind, begin = known.place_type, known.start

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, ids, before, second in _streams(batches, begin, kind):
            totals = np.zeros(len(batch))
            if n:
                weights, tree, inside = shared.value
                doc = np.repeat(np.arange(len(batch)), batch["n_tokens"].to_numpy())
                totals += np.bincount(doc, weights=inside[ids], minlength=len(batch))
                for at in range(0, len(ids), BATCH):
                    here = slice(at, at + BATCH)
                    token, node, branch = tree.steps(ids[here])
                    z = _logits(weights, tree.bias[node], _features(before[here][token], second[here][token], node, len(weights)))
                    value = z[branch, np.arange(len(token))] - np.log(np.exp(z).sum(axis=0))
                    totals += np.bincount(doc[here][token], weights=value, minlength=len(batch))
            out = batch.drop(columns="ids")
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["model_log"] = totals / math.log(10)
            yield out

    kept = "row_id", "doc_id", "held_out", "n_tokens", "head_log", "head_rare", "head_known"
    schema = (
        "row_id long, doc_id long, held_out boolean, n_tokens long, head_log double, head_rare double, head_known long, "
        "model_log double"
    )
    scored = mapped(coded.select(*kept, "ids"), score, schema).join(tail, "row_id", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    denominator = math.log10(n + v + 1)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("model_log") + F.col("head_rare") + tail_log).alias("score") if n else F.lit(0.0).alias("score"),
    )
