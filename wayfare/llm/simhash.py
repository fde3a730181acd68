"""SimHash fingerprints and an exact search for near fingerprints in tiles.

Tiles of fingerprints are compared with numpy's exclusive-or and bit counts; inside a task the fingerprints are
sorted by their number of one bits, and a pair of tiles whose bit counts differ by more than the radius is skipped,
because every differing bit moves the count by one at most. Spark deals the work out by the pigeonhole principle:
with a radius r, two near fingerprints agree on at least one of r + 1 parts of their bits, so each distinct
fingerprint goes to r + 1 groups and all tiles of a group share that part. A group with more than `max_group`
fingerprints is dealt again by r + 1 parts of its remaining bits, which is exact for the same reason, until none is
larger; so no task compares an unbounded group, however many near copies of one text there are. A task returns the
tree of its links (each fingerprint with the smallest one it reaches), never pairs; the trees are joined by
connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import free_name, mapped, numbered, slices
from wayfare.llm.components import components
from wayfare.session import written

BITS = 64
TILE = 1024
MAX_GROUP = 4096


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """A bit is one if it is set in more than half of the shingles' hashes; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in batch["text"].tolist()], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), "fp": fps.view(np.int64)})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), hashed, "doc_id long, fp long")


def _tile_links(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of a root; roots are equal exactly where links connect."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int16)
    root = np.arange(len(fps))

    def find(nodes: np.ndarray) -> np.ndarray:
        while True:
            up = root[nodes]
            if (up == nodes).all():
                return nodes
            nodes = up

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = find(a), find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(root, high, low)

    for i in range(0, len(fps), TILE):
        for j in range(i, len(fps), TILE):
            if counts[j] - counts[min(i + TILE, len(fps)) - 1] > radius:
                break
            near = np.bitwise_count(fps[i : i + TILE, None] ^ fps[None, j : j + TILE]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            keep = a < b
            if keep.any():
                unite(a[keep], b[keep])
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[find(np.arange(len(fps)))]
    return out


def _links_in_groups(radius: int):
    """Rows (g1, g2, fp) sorted by group -> (u, v): every linked fingerprint with the root of its tree."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        current = None

        def tree() -> tuple[np.ndarray, np.ndarray]:
            fps = np.concatenate(held)
            root = _tile_links(fps.view(np.uint64), radius)
            apart = root != np.arange(len(fps))
            return fps[apart], fps[root[apart]]

        for batch in batches:
            g1, g2, fps = batch["g1"].to_numpy(), batch["g2"].to_numpy(), batch["fp"].to_numpy()
            cuts = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                key = (g1[a], g2[a])
                if key != current:
                    if sum(map(len, held)) > 1:
                        found.append(tree())
                    held, current = [], key
                held.append(fps[a:b])
            if found:
                yield pd.DataFrame({"u": np.concatenate([x[0] for x in found]), "v": np.concatenate([x[1] for x in found])})
        if sum(map(len, held)) > 1:
            u, v = tree()
            yield pd.DataFrame({"u": u, "v": v})

    return links


def _parts(bits: list[int], n: int) -> list[list[int]]:
    size, extra = divmod(len(bits), n)
    out, at = [], 0
    for k in range(n):
        out.append(bits[at : at + size + (k < extra)])
        at += size + (k < extra)
    return out


def _agreed(path: int, n: int) -> list[int]:
    """The bits that a group agrees on. Its path is a one and then, in base n, the part chosen at each dealing."""
    steps = []
    while path > 1:
        path, step = divmod(path, n)
        steps.append(step)
    bits: list[int] = []
    for step in reversed(steps):
        bits += _parts([b for b in range(BITS) if b not in bits], n)[step]
    return bits


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows (g1, fp) of groups with path g1 -> rows (g1, g2, fp) of the n finer groups that each belongs to."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths, fps = batch["g1"].to_numpy(), batch["fp"].to_numpy()
            for path in np.unique(paths).tolist():
                here = fps[paths == path]
                for step in range(n):
                    mask = np.uint64(sum(1 << b for b in _agreed(path * n + step, n)))
                    yield pd.DataFrame({"g1": path * n + step, "g2": (here.view(np.uint64) & mask).view(np.int64), "fp": here})

    return mapped(rows, deal, "g1 long, g2 long, fp long")


def near_links(fps: DataFrame, radius: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints of `fps` within `radius` bits of one another.

    Dealing ends by itself: a group that agrees on all but b bits has at most 2**b distinct fingerprints.
    """
    max_group = max(max_group, 1 << (radius + 1))  # a group that agrees on all but radius bits is never larger
    pending, small = fps.select(F.lit(1).cast("long").alias("g1"), "fp").distinct(), None
    while True:
        dealt = written(_dealt(pending, radius + 1), "simhash-groups")
        # Written, so that the joins read two plain shuffles, which Spark can split where a group is hot.
        sizes = written(dealt.groupBy("g1", "g2").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        part = dealt.join(sizes.filter(F.col("n") <= max_group), ["g1", "g2"], "left_semi")
        small = part if small is None else small.unionAll(part)
        large = sizes.filter(F.col("n") > max_group)
        if large.isEmpty():
            break
        pending = dealt.join(large, ["g1", "g2"], "left_semi").select("g1", "fp")
    grouped = small.repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return mapped(grouped, _links_in_groups(radius), "u long, v long")


def near_components(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root) of every fingerprint of `rows` that has a near one; root is the smallest it reaches."""
    return components(near_links(rows, radius)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with equal fingerprints
    are one node, however many there are. A null doc_id stays null and is never a component's id unless all are
    null. An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """
    rows = written(with_fingerprints(docs, shingle, seed), "fingerprints")
    roots = near_components(rows, radius)
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_fp = ids.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(by_fp.select("fp", "root").join(by_root, "root").select("fp", "component_id"), "simhash-labels")
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """The rows of `docs`, one of each component of near fingerprints, with all their columns.

    The row with the smallest doc_id stays; of rows with one id the first read, and null ids come last. Null, empty
    and blank texts share fingerprint zero, so one of them stays. An empty table gives no rows. Helper columns take
    names that `docs` does not have, so no column can clash.
    """
    names = docs.columns
    fp, row = free_name(names, "fp"), free_name(names, "row")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in batch["text"].tolist()], dtype=np.uint64)
            out = batch[names].copy()
            out[fp] = fps.view(np.int64)
            yield out

    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    rows = written(numbered(mapped(docs, hashed, schema), row), "fingerprinted")
    narrow = rows.select(F.col(fp).alias("fp"), F.col(row).alias("row"), "doc_id")
    roots = near_components(narrow, radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = narrow.groupBy("fp").agg(F.min(order).alias("first")).join(roots, "fp", "left")
    first = first.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(first, row, "left_semi").select(*[f"`{c}`" for c in names])
