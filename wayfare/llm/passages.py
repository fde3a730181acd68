"""Repeated passages of words, found by backward search in compressed indexes of shards.

A stretch of `length` words that also starts in a document with a smaller id is removed. Documents are not compared
with one another; stretches meet in shards by content:

1. Every stretch has an anchor, the gram of GRAM words in it with the least hash, the leftmost of several. Equal stretches
   have equal anchors. Neighbouring stretches with one anchor are a run, which is one row (some 60 bytes, no words).
2. Anchors that one document alone holds are dropped: their stretches occur nowhere else.
3. Runs with the same words are one run with the smallest id, however many copies there are, so a group of copies
   is one run per place. One text of each different run gives its words.
4. Runs are dealt to shards by anchor. A shard's runs are indexed (suffix order, wavelet tree) and streamed through
   the index: matching statistics cut at `length` name the smallest document of every stretch. Runs of an anchor
   with more than `hot_runs` different runs would not fit a shard; their stretches are told apart by a hash of
   all their words instead, and grouped by it.
5. What is found goes back to the runs by name, and the covered words to the documents.

Words, grams, runs and hot stretches are named by 64-bit hashes; results are exact but for collisions of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import mapped_arrow
from wayfare.llm.fm_index import FmIndex, flat_positions
from wayfare.session import written

GRAM = 8  # words of an anchor
SLICE_WORDS = 1 << 20  # words worked on at a time, at least one text
SHARD_WORDS = 1 << 20  # words in one index, about
HOT_RUNS = 10_000  # different runs of one anchor that still go into one index
CACHE_WORDS = 500_000  # forgotten when full; bounds the memory of a worker, never the result
LAST = (1 << 63) - 1  # the place of a null id in the order: after all others
# Odd multipliers of the rolling hashes, fixed.
_RUN, _GRAM = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Words:
    """64-bit names of words, learned once per task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        get = self.known.get
        found = [get(w) for w in words]
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for k, name in enumerate(found):
                if name is None:
                    found[k] = self.known[words[k]] = xxh3_64_intdigest(words[k])
        return np.array(found, dtype=np.uint64)


class _Rolling:
    """Hashes of any stretch of a sequence from running sums; the same words give the same hash at every place."""

    def __init__(self, names: np.ndarray, multiplier: int) -> None:
        inverse = np.uint64(pow(multiplier, -1, 1 << 64))
        powers = np.full(len(names) + 1, np.uint64(multiplier))
        powers[:1] = 1
        self.back = np.full(len(names) + 1, inverse)
        self.back[:1] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(self.back, out=self.back)
        self.sums = np.append(np.uint64(0), np.cumsum(names * powers[:-1]))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        mixed = (self.sums[stop] - self.sums[start]) * self.back[start]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(29))


def _least_left(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every `width` neighbouring hashes (their upper halves), the leftmost of several."""
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(names: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of texts laid end to end: text, start (in the text), n (stretches), anchor, name."""
    which, place = flat_positions(lengths)
    usable = len(names) - length + 1
    if usable <= 0:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "anchor", "name")}
    at = np.arange(usable)
    at = at[place[:usable] + length <= lengths[which[:usable]]]
    rolling = _Rolling(names, _GRAM)
    grams = np.arange(len(names) - gram + 1)
    hashes = rolling(grams, grams + gram)
    anchor = _least_left(hashes, length - gram + 1)[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    return {
        "text": which[start],
        "start": place[start],
        "n": n,
        "anchor": hashes[anchor[first]].view(np.int64),
        "name": _Rolling(names, _RUN)(start, start + n + length - 1).view(np.int64),
    }


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of batches with the words of their texts; a null text has none."""
    for batch in batches:
        held, begin, n = [], 0, 0
        for k, text in enumerate(batch.column("text")):
            held.append((text.as_py() or b"").split())  # bytes: exactly the ASCII white space
            n += len(held[-1])
            if n >= SLICE_WORDS:
                yield batch.slice(begin, k + 1 - begin), held
                held, begin, n = [], k + 1, 0
        if held:
            yield batch.slice(begin), held


def _named(words: _Words, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    return words([w for t in texts for w in t]), np.array([len(t) for t in texts], np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(ord, key, text): equal rows have equal keys, so nothing depends on where a row is read."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64("text").alias("key"),
        F.col("text").cast("binary").alias("text"),
    )


def _runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch, texts in _sliced(batches):
            out = runs(*_named(words, texts), length, gram)
            rows = pa.array(out.pop("text"))
            columns = {"ord": batch.column("ord").take(rows), "key": batch.column("key").take(rows)}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in out.items()})

    return mapped_arrow(docs, found, "ord long, key long, start long, n long, anchor long, name long")


def _words_of(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(anchor, name, least, hot, words) of the runs of `chosen` (ord, key, start, n, anchor, name, least, hot)."""
    held = chosen.groupBy("ord", "key").agg(F.collect_list(F.struct("start", "n", "anchor", "name", "hot")).alias("held"))
    texts = docs.join(held, ["ord", "key"]).dropDuplicates(["ord", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch, texts in _sliced(batches):
            names, lengths = _named(words, texts)
            lists = batch.column("held")
            inner = lists.flatten()
            row = np.repeat(np.arange(len(lengths)), np.diff(lists.offsets.to_numpy()))
            start = (np.cumsum(lengths) - lengths)[row] + inner.field("start").to_numpy()
            size = inner.field("n").to_numpy() + length - 1
            which, place = flat_positions(size)
            picked = names[start[which] + place]
            ends = np.append(0, np.cumsum(size * 8)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": inner.field("anchor"),
                    "name": inner.field("name"),
                    "least": batch.column("ord").take(pa.array(row)),
                    "hot": inner.field("hot"),
                    "words": pa.Array.from_buffers(
                        pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(picked))]
                    ),
                }
            )

    return mapped_arrow(texts, cut, "anchor long, name long, least long, hot boolean, words binary")


_FOUND = "anchor long, name long, first long, last long, least long"


def _found(anchor: np.ndarray, name: np.ndarray, lengths: np.ndarray, place: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Neighbouring stretches of a run with one least document, as one row."""
    by = np.argsort(place, kind="stable")
    place, least = place[by], least[by]
    which, inside = flat_positions(lengths)
    row, at = which[place], inside[place]
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))[: len(row)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    columns = [anchor[row[first]], name[row[first]], at[first], at[last], least[first]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "name", "first", "last", "least"])


def _in_shards(words: DataFrame, length: int, shard_words: int) -> DataFrame:
    """Index and stream the runs of a partition, sorted by anchor, some whole anchors at a time."""

    def shard(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = rows.column("words").chunk(0)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        names = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
        lengths = np.diff(ends).astype(np.int64) // 8
        anchor, name, owner = (rows.column(c).to_numpy() for c in ("anchor", "name", "least"))
        index = FmIndex(names, lengths, owner, length)
        return _found(anchor, name, lengths, *index.stretches(names, lengths))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            anchors = batch.column("anchor").to_numpy()
            edges = [*(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), batch.num_rows]
            sizes, begin, used = np.diff(np.append(0, np.cumsum(pa.compute.binary_length(batch.column("words")).to_numpy()))) // 8, 0, 0
            upto = np.append(0, np.cumsum(sizes))
            if held and size >= shard_words and batch.num_rows and held[-1].column("anchor")[-1].as_py() != anchors[0]:
                yield shard(pa.Table.from_batches(held))
                held, size = [], 0
            for edge in edges:
                if edge < batch.num_rows and size + upto[edge] - upto[begin] >= shard_words:
                    held.append(batch.slice(begin, edge - begin))
                    yield shard(pa.Table.from_batches(held))
                    held, size, begin = [], 0, edge
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                size += int(upto[-1] - upto[begin])
        if held:
            yield shard(pa.Table.from_batches(held))

    dealt = words.repartition("anchor").sortWithinPartitions("anchor")
    return mapped_arrow(dealt.select("anchor", "name", "least", "words"), found, _FOUND)


def _by_hash(words: DataFrame, length: int) -> DataFrame:
    """The stretches of hot anchors, grouped by two hashes of all their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                held = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("words")]
                names, lengths = np.concatenate(held), np.array([len(x) for x in held])
                which, place = flat_positions(lengths)
                start = np.flatnonzero(place + length <= lengths[which])
                rows = pa.array(which[start])
                columns = {c: batch.column(c).take(rows) for c in ("anchor", "name", "least")}
                columns["first"] = pa.array(place[start])
                for c, multiplier in (("h1", _RUN), ("h2", _GRAM)):
                    columns[c] = pa.array(_Rolling(names, multiplier)(start, start + length).view(np.int64))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "anchor long, name long, least long, first long, h1 long, h2 long"
    stretches = written(mapped_arrow(words.select("anchor", "name", "least", "words"), cut, schema), "hot-stretches")
    least = stretches.groupBy("h1", "h2").agg(F.min("least").alias("least"))
    return stretches.drop("least").join(least, ["h1", "h2"]).select("anchor", "name", "first", F.col("first").alias("last"), "least")


def covered(
    docs: DataFrame, length: int = 50, gram: int = GRAM, hot_runs: int = HOT_RUNS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(ord, key, spans): first and last start of the stretches that also start in a document with a smaller id."""
    gram = min(gram, length)
    keyed = _keyed(docs)
    found = written(_runs_of(keyed, length, gram), "passage-runs")
    shared = found.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).filter("a < b").select("anchor")
    # Written, so that the join reads two plain shuffles, which Spark can split where an anchor is hot.
    shared = written(shared, "passage-anchors")
    found = written(found.join(shared, "anchor", "left_semi"), "passage-shared")
    pick = F.min(F.struct("ord", "key", "start", "n"))
    different = written(found.groupBy("anchor", "name").agg(pick.alias("pick")), "passage-different")
    hot = different.groupBy("anchor").count().filter(F.col("count") > hot_runs).select("anchor", F.lit(True).alias("hot"))
    chosen = different.join(written(hot, "passage-hot"), "anchor", "left")
    chosen = chosen.select("pick.*", "anchor", "name", F.coalesce("hot", F.lit(False)).alias("hot"))
    words = written(_words_of(keyed, chosen, length), "passage-words")
    results = _in_shards(words.filter("not hot"), length, shard_words)
    if not words.filter("hot").isEmpty():
        results = results.unionAll(_by_hash(words.filter("hot"), length))
    results = written(results, "passage-found")
    spans = found.select("ord", "key", "start", "anchor", "name").distinct().join(results, ["anchor", "name"]).filter("least < ord")
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return spans.groupBy("ord", "key").agg(F.collect_list(span).alias("spans"))


def _removed(n: int, spans, length: int) -> np.ndarray:
    """Which of n words lie in a stretch of the spans."""
    edges = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        np.add.at(edges, spans.field("first").to_numpy(), 1)
        np.add.at(edges, spans.field("last").to_numpy() + length, -1)
    return np.cumsum(edges[:-1]) > 0


def dedup_passages(
    docs: DataFrame,
    length: int = 50,
    gram: int = GRAM,
    hot_runs: int = HOT_RUNS,
    shard_words: int = SHARD_WORDS,
    with_text: bool = False,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, and with `with_text` the kept words as text.

    Words are runs of characters that are no ASCII white space. A word is removed if it lies in a stretch of `length`
    words that also starts in a document with a smaller id, judged on the input. Null, empty and blank texts have no
    words. Rows with one id do not remove one another's words; a null id comes after all others. Repeated rows give
    repeated results, an empty table none. Only doc_id and text are read, so other columns cannot clash.
    """
    keyed = _keyed(docs)
    joined = keyed.withColumn("doc_id", F.when(F.col("ord") < LAST, F.col("ord")))
    joined = joined.join(written(covered(docs, length, gram, hot_runs, shard_words), "passage-spans"), ["ord", "key"], "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _sliced(batches):
            n, gone, sums, out = [], [], [], []
            for words, spans in zip(texts, batch.column("spans")):
                drop = _removed(len(words), spans.values, length) if spans.is_valid else np.zeros(len(words), bool)
                rest = b" ".join([w for w, x in zip(words, drop.tolist()) if not x] if drop.any() else words)
                n.append(len(words))
                gone.append(int(drop.sum()))
                sums.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    out.append(rest.decode("utf-8"))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array(sums, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"text": pa.array(out, pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return mapped_arrow(joined.select("doc_id", "text", "spans"), kept, schema)
