"""Hard negatives by inner products, with length buckets and sorted coordinate lists (after LEMP).

Rows are dealt to shards by length and, inside a shard, to buckets of rows of similar length. A bucket holds the
sorted values of every coordinate of its normalised rows. An anchor that needs a score of at least t from a row needs a
cosine of at least c = t / (length of the anchor * greatest length in the bucket): a bucket with c > 1 is skipped.
By Cauchy and Schwarz a row with that cosine has, in each coordinate, a value whose angle is within arccos(c) of the
anchor's. For the coordinates in which the anchor is largest (its focus) these ranges are looked up in the sorted
lists, the candidates are the intersection, and only they are scored exactly, in whole numbers. t rises as results
come in.

Anchors are a stated set of queries: blocks of them are streamed through each shard, whose buckets stay in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import mapped_arrow
from wayfare.session import written

BUCKET_ROWS = 2048
SHARD_ROWS = 65_536  # rows of a shard at most, about; fewer where there are more cores than shards
LEAST_SHARD_ROWS = 4096
ANCHOR_ROWS = 256
FOCUS = 4
WIDEST = 0.8  # with more of a bucket than this in range, all of it is scored
LARGEST = float(1 << 62)  # squared length from which scores would not fit a long
EXACT = 2.0**53


@dataclass
class Bucket:
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    longest: float
    values: np.ndarray  # sorted, one column per coordinate
    order: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Bucket:
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        unit = rows / np.where(lengths > 0, lengths, 1.0)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        longest = float(lengths.max(initial=0.0))
        exact = rows.astype(np.float64) if longest * longest < EXACT else rows
        return Bucket(ids, labels, exact, longest, np.take_along_axis(unit, order, axis=0), order)

    def candidates(self, anchor: np.ndarray, length: float, focus: np.ndarray, least: float) -> np.ndarray | slice | None:
        """Rows that may score `least` or more with the anchor: none, all, or their places."""
        if least <= 0:
            return slice(None)
        if length * self.longest <= 0:
            return None
        cosine = least / (length * self.longest) * (1 - 1e-9)
        if cosine > 1:
            return None
        reach = np.arccos(cosine)
        focus = focus[focus < self.values.shape[1]]
        angle = np.arccos(np.clip(anchor[focus] / length, -1, 1))
        low = np.cos(np.minimum(np.pi, angle + reach)) - 1e-9
        high = np.cos(np.maximum(0.0, angle - reach)) + 1e-9
        first = [int(np.searchsorted(self.values[:, f], x, "left")) for f, x in zip(focus, low)]
        last = [int(np.searchsorted(self.values[:, f], x, "right")) for f, x in zip(focus, high)]
        by_size = sorted(range(len(focus)), key=lambda k: last[k] - first[k])
        if not by_size or last[by_size[0]] - first[by_size[0]] > WIDEST * len(self.ids):
            return slice(None)
        k = by_size[0]
        found = self.order[first[k] : last[k], focus[k]]
        held = np.zeros(len(self.ids), bool)
        for k in by_size[1:]:
            held[:] = False
            held[self.order[first[k] : last[k], focus[k]]] = True
            found = found[held[found]]
        return found

    def scores(self, places: np.ndarray | slice, anchor: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products; shorter vectors go on with zeros."""
        rows, width = self.rows[places], min(self.rows.shape[1], len(anchor))
        if rows.dtype == np.float64 and length * self.longest < EXACT:
            return (rows[:, :width] @ anchor[:width].astype(np.float64)).astype(np.int64)
        return rows[:, :width].astype(np.int64) @ anchor[:width]


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n highest scores, ties by the smaller id."""
    if len(ids) > 4 * n:
        kept = scores >= np.partition(scores, len(scores) - n)[len(scores) - n]
        ids, scores = ids[kept], scores[kept]
    order = np.lexsort((ids, -scores))[:n]
    return ids[order], scores[order]


class Shard:
    def __init__(self, buckets: list[Bucket]) -> None:
        self.buckets = sorted(buckets, key=lambda b: -b.longest)

    def search(self, anchor_id: int, label: int, anchor: np.ndarray, same: bool, windows: list[tuple[int, int]], n: int):
        """For each window (least and greatest score) the n best rows of the same or of another label: (ids, scores)."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
        empty = np.zeros(0, np.int64)
        found, least = [(empty, empty)] * len(windows), [low for low, _ in windows]
        for bucket in self.buckets:
            places = bucket.candidates(anchor, length, focus, min(least))
            if places is None:
                continue
            scores, ids, labels = bucket.scores(places, anchor, length), bucket.ids[places], bucket.labels[places]
            fits = (labels == label) & (ids != anchor_id) if same else labels != label
            for k, (_, high) in enumerate(windows):
                kept = fits & (scores >= least[k]) & (scores <= high)
                if kept.any():
                    held = found[k]
                    found[k] = best(np.append(held[0], ids[kept]), np.append(held[1], scores[kept]), n)
                    if len(found[k][0]) == n:
                        least[k] = max(least[k], int(found[k][1][-1]))
        return found


# Spark

_PACKED = "kind int, n int, width int, ids binary, labels binary, vectors binary, windows binary"
ANY = (-(1 << 63), (1 << 63) - 1)


def prepared(vectors: DataFrame, scale: int, shift_every: int, n_labels: int) -> DataFrame:
    """(id, label, vector, size): whole-number vectors of the rows that take part, one per vec_id."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % n_labels).otherwise(label)
    whole = F.transform(x, lambda v: F.floor(v * scale))
    size = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * scale).cast("double"), F.lit(2.0)))
    given = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(good).filter(size < LARGEST)
    rows = given.select(F.col("vec_id").cast("long").alias("id"), shifted.alias("label"), whole.alias("vector"), size.alias("size"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "size")).alias("x"))
    return one.select("id", "x.label", "x.vector", "x.size")


def _packed(rows: DataFrame, most: int, kind: int, with_windows: bool) -> DataFrame:
    """Rows of a partition packed in blocks of at most `most`: ids, labels and vectors as bytes of whole numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(part: pa.Table) -> dict:
            lists = part.column("vector").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
            columns = {c: part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label")}
            windows = part.column("windows").combine_chunks().flatten().to_numpy().astype(np.int64).tobytes() if with_windows else b""
            row = {"kind": kind, "n": len(sizes), "width": matrix.shape[1], "ids": columns["id"], "labels": columns["label"]}
            return row | {"vectors": matrix.tobytes(), "windows": windows}

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                whole = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_pylist([block(whole.slice(0, most))], schema=kinds)
                held, n = whole.slice(most).to_batches(), n - most
        if n:
            yield pa.RecordBatch.from_pylist([block(pa.Table.from_batches(held))], schema=kinds)

    numbers, data = ("kind", "n", "width"), ("ids", "labels", "vectors", "windows")
    kinds = pa.schema([*((c, pa.int32()) for c in numbers), *((c, pa.binary()) for c in data)])
    return mapped_arrow(rows.select("id", "label", "vector", *["windows"] * with_windows), pack, _PACKED)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["width"])


def _searched(buckets: DataFrame, anchors: DataFrame, shards: int, same: bool, n: int, per_anchor: int) -> DataFrame:
    """Stream blocks of anchors through every shard: (anchor, window, id, score), the best n of a shard each."""
    sent = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    together = buckets.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at:
                    at, held, shard = row["shard"], [], None
                if row["kind"] == 0:
                    held.append(Bucket.of(*_unpacked(row)))
                    continue
                if shard is None:
                    shard, held = Shard(held), []
                ids, labels, vectors = _unpacked(row)
                bounds = np.frombuffer(row["windows"], np.int64).reshape(len(ids), -1, 2) if per_anchor else None
                out: list[tuple[np.ndarray, ...]] = []
                for k, (i, label, vector) in enumerate(zip(ids.tolist(), labels.tolist(), vectors)):
                    windows = [ANY] if bounds is None else [tuple(w) for w in bounds[k].tolist()]
                    for w, (others, scores) in enumerate(shard.search(i, label, vector, same, windows, n)):
                        out.append((np.full(len(others), i), np.full(len(others), w), others, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "window", "id", "score"])

    return mapped_arrow(together, search, "anchor long, window long, id long, score long")


def _first(found: DataFrame, n: int) -> DataFrame:
    """The best n over all shards, numbered from 1; a group has n rows per shard at most."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(
    vectors: DataFrame,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    shift_every: int = 7,
    n_labels: int = 10,
    shard_rows: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its first `positives` rows of the same label, the best `negatives` rows of other labels
    whose score is between `low` and `high` percent of the positive's; higher scores first, ties by smaller id. Rows
    with a null id, label or vector, or with a null or non-finite component take no part, nor do rows whose squared
    length is 2**62 or more, whose scores would not fit a long. Vectors of different lengths are filled up with
    zeros. Rows with one vec_id count once, the one with the least label and vector. An anchor without positives and a
    positive without negatives give no rows; so does an empty table. Only vec_id, label and embedding are read, so
    other columns cannot clash.
    """
    spark = vectors.sparkSession
    rows = written(prepared(vectors, scale, shift_every, n_labels), "negatives-rows")
    n = rows.count()
    if shard_rows is None:
        shard_rows = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    shards = max(1, -(-n // shard_rows))
    ranged = rows.repartitionByRange(shards, "size", "id").sortWithinPartitions("size", "id")
    buckets = _packed(ranged, bucket_rows, 0, False).withColumn("shard", F.spark_partition_id())
    buckets = written(buckets, "negatives-buckets")
    asking = rows.filter(F.col("id") % anchor_every == 0)
    anchors = written(_packed(asking, ANCHOR_ROWS, 1, False), "negatives-anchors")
    near = _first(_searched(buckets, anchors, shards, True, positives, 0), positives).select("anchor", "rank", "id", "score")
    near = written(near, "negatives-positives")

    # Whole-number bounds of the scores that fit: ceil(low * p / 100) and floor(high * p / 100).
    exact = F.col("score").cast("decimal(20,0)")
    bounds = F.array(F.ceil(exact * low / 100).cast("long"), F.floor(exact * high / 100).cast("long"))
    none = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))  # a window that nothing fits
    held = near.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("rank", bounds))).alias("held"))
    windows = F.flatten(F.array(*(F.coalesce(F.element_at("held", k + 1), none) for k in range(positives)))).alias("windows")
    asking = asking.join(held, "id").select("id", "label", "vector", windows)
    anchors = written(_packed(asking, ANCHOR_ROWS, 1, True), "negatives-windows")
    found = _first(_searched(buckets, anchors, shards, False, negatives, positives), negatives)
    window = (F.col("rank") - 1).cast("long").alias("window")
    asked = near.select("anchor", window, F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(asked, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


MINE_SQL = """
WITH given AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           list_inner_product(a.c, b.c)::BIGINT AS score
    FROM given a JOIN given b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), near AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM near p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 10
"""
