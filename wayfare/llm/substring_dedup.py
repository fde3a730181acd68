"""Repeated byte strings by induced suffix sorting on sampled suffixes.

Every byte of a document that lies in a string of `length` bytes which also starts somewhere else is found exactly.

1. Sampled suffixes. As induced sorting starts from a sample of suffixes chosen by content, each window of `length`
   bytes is assigned to its smallest `GRAM`-byte gram under a hash, the window's anchor. Equal windows have equal
   anchors at equal distances, so consecutive windows with one anchor form a segment, and a window can only
   repeat inside segments that share the anchor's gram. About one byte in eighty is an anchor.
2. Naming. Segments are counted by (gram, segment) hash with map-side combine. A gram that occurs once is settled:
   nothing repeats. A gram whose segments are all equal is settled: all repeats. The rest is sorted.
3. Induction. Spark deals the unsettled segments out by gram and sorts them there (its sorter spills to disk, which
   makes the shuffle the external queue of this sort). A task reads whole grams in runs of bounded size. It sorts the
   suffixes that start at the anchors and computes their common prefixes, then induces the order of the
   suffixes one byte further left, again and again: a stable pass by the byte in front keeps equal bytes in the order
   of what follows, and the common prefix of two neighbours is one more than the smallest value between them before.
   Windows whose common prefix reaches `length` repeat.
4. Recursion for hot grams. A gram with more than `MAX_SEGMENTS` different segments is no bounded group; there each
   window becomes its own anchor (a gram of the full length), and equal windows are counted by a Spark aggregate.

No group is unbounded in any task, texts are read whole, and only documents' own bytes move in compressed form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import mapped, slices
from wayfare.session import written

LENGTH = 200
GRAM = 40
CHUNK = 1 << 18  # bytes worked on at a time; window numbers need 24 bits
RUN_ROWS = 40_000  # segments that a task sorts at a time, rounded up to whole grams
MAX_SEGMENTS = 20_000
_LOW = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=2)
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, powers of an odd base and of its inverse, all modulo 2**64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
    inverse = pow(base, -1, 1 << 64)
    size = CHUNK * 2 + 2 * LENGTH

    def powers(x: int) -> np.ndarray:
        out = np.full(size, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return values, powers(base), powers(inverse)


def _prefix_hash(data: np.ndarray, seed: int) -> np.ndarray:
    values, up, _ = _tables(seed)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """lo, windows, distance to the anchor, gram hash and segment hash of all segments.

    `ends` has the end of its document for each byte; windows that would cross it are none.
    """
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none
    prefix, down = _prefix_hash(data, 1), _tables(1)[2]
    hashes = _mixed((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    wide = length - gram + 1
    padded = np.full(-(-len(keys) // wide) * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, wide)
    first = np.minimum.accumulate(blocks, axis=1).ravel()
    last = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(last[:windows], first[wide - 1 : wide - 1 + windows]) & _LOW).astype(np.int64)
    at = np.flatnonzero(np.arange(windows) + length <= ends[:windows])
    if not len(at):
        return none, none, none, none, none
    chosen = anchor[at]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(chosen) != 0)]))
    lo = at[begin]
    count = np.diff(np.append(begin, len(at)))
    rel = chosen[begin] - lo
    stop = lo + count + length - 1
    second, down = _prefix_hash(data, 2), _tables(2)[2]
    whole = (second[stop] - second[lo]) * down[lo]
    whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + (rel * 1024 + count).astype(np.uint64))
    return lo, count, rel, hashes[chosen[begin]].view(np.int64), whole.view(np.int64)


def _anchors(length: int, gram: int):
    columns = ["k1", "k2", "lo", "nw", "rel", "gram", "segment"]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(held: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
            sizes = np.array([len(x[3]) for x in held])
            stops = np.cumsum(sizes)
            starts = stops - sizes
            data = np.frombuffer(b"".join(x[3] for x in held), dtype=np.uint8)
            lo, nw, rel, gr, seg = segments(data, np.repeat(stops, sizes), length, gram)
            doc = np.searchsorted(stops, lo, side="right")
            shift = np.array([x[2] for x in held], dtype=np.int64)
            k1, k2 = (np.array([x[i] for x in held], dtype=np.int64) for i in (0, 1))
            at = lo - starts[doc] + shift[doc]
            return pd.DataFrame(dict(zip(columns, (k1[doc], k2[doc], at, nw, rel, gr, seg))))

        held, size = [], 0
        for batch in slices(batches):
            for k1, k2, text in zip(batch["k1"].tolist(), batch["k2"].tolist(), batch["text"].tolist()):
                raw = text.encode("utf-8")
                for at in range(0, max(1, len(raw) - length + 1), CHUNK):  # a long text in overlapping parts
                    part = raw[at : at + CHUNK + length - 1]
                    if len(part) < length:
                        continue
                    if size + len(part) > 2 * CHUNK:
                        yield flush(held)
                        held, size = [], 0
                    held.append((k1, k2, at, part))
                    size += len(part)
        if held:
            yield flush(held)

    return found


def repeated_by_induction(
    parts: list[bytes], rel: np.ndarray, nw: np.ndarray, length: int
) -> np.ndarray:
    """For each segment and distance d (0 to the largest rel): does the window d bytes left of the anchor repeat?

    A window counts as repeated if it is found in two of the segments, which must differ from one another.
    """
    n, deepest = len(parts), int(rel.max(initial=0))
    right = np.zeros((n, length), dtype=np.uint8)
    left = np.zeros((n, max(1, deepest)), dtype=np.uint8)
    for i, part in enumerate(parts):
        a = int(rel[i])
        after = np.frombuffer(part, dtype=np.uint8, offset=a)[:length]
        right[i, : len(after)] = after
        if a:
            left[i, :a] = np.frombuffer(part, dtype=np.uint8, count=a)[::-1]
    repeated = np.zeros((n, deepest + 1), dtype=bool)
    order = np.argsort(right.view(f"S{length}").ravel(), kind="stable")
    common = np.zeros(n, dtype=np.int64)
    for at in range(1, n, 1 << 14):
        a, b = right[order[at - 1 : at - 1 + (1 << 14)]], right[order[at : at + (1 << 14)]]
        differ = a[: len(b)] != b
        common[at : at + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    for d in range(deepest + 1):
        if not len(order):
            break
        valid = (rel[order] - nw[order] < d) & (d <= rel[order])
        cluster = np.cumsum(common < length) - (common[0] < length)
        repeated[order, d] = valid & (np.bincount(cluster, weights=valid)[cluster] >= 2)
        alive = np.flatnonzero(rel[order] > d)  # suffixes that end here leave; prefixes meet across them
        if not len(alive):
            break
        common = np.minimum.reduceat(common[: alive[-1] + 1], np.append(0, alive[:-1] + 1))
        order = order[alive]
        byte = left[order, d]
        moved = np.argsort(byte, kind="stable")
        order, byte = order[moved], byte[moved]
        bounds = np.empty(2 * (len(moved) - 1), dtype=np.int64)
        bounds[0::2], bounds[1::2] = moved[:-1] + 1, moved[1:] + 1
        same = np.flatnonzero(byte[1:] == byte[:-1])
        inside = np.zeros(len(order), dtype=np.int64)
        if len(same):
            some = np.stack([bounds[0::2][same], bounds[1::2][same]], axis=1).ravel()
            least = np.minimum.reduceat(np.append(common, 0), some)[0::2]
            inside[same + 1] = np.minimum(least + 1, length)
        common = inside
    return repeated


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of the runs of true cells in the rows of a table; only the ends of runs are listed."""
    edge = np.zeros((len(marked), 1), dtype=bool)
    bounded = np.hstack([edge, marked, edge])
    row, at = np.nonzero(bounded[:, 1:] != bounded[:, :-1])  # begin and end of each run in turn
    return row[0::2], at[0::2], at[1::2] - at[0::2]


def _sorted_runs(length: int):
    """Segments in order of their gram -> runs of repeated windows, as ranges of window starts."""

    def ranges(rows: pd.DataFrame) -> pd.DataFrame:
        rel, nw = rows["rel"].to_numpy().astype(np.int64), rows["nw"].to_numpy().astype(np.int64)
        repeated = repeated_by_induction(rows["part"].tolist(), rel, nw, length)
        repeated &= (rows["n"].to_numpy() == 1)[:, None]  # the others are settled
        row, first, size = runs_of(repeated[:, ::-1])  # ascending window starts
        head = rows.iloc[row]
        return pd.DataFrame(
            {
                "k1": head["k1"].to_numpy(),
                "k2": head["k2"].to_numpy(),
                "lo": head["lo"].to_numpy() + rel[row] - (repeated.shape[1] - 1 - first),
                "nw": size,
            }
        )

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            while len(batch):
                if rows >= RUN_ROWS:  # cut where a gram ends
                    key = held[-1]["gram"].iloc[-1]
                    same = int((batch["gram"].to_numpy() == key).cumprod().sum())
                    held.append(batch.iloc[:same])
                    batch = batch.iloc[same:]
                    if not len(batch):
                        rows += same
                        break
                    yield ranges(pd.concat(held, ignore_index=True))
                    held, rows = [], 0
                take = batch.iloc[:RUN_ROWS]
                held.append(take)
                rows += len(take)
                batch = batch.iloc[RUN_ROWS:]
        if held:
            yield ranges(pd.concat(held, ignore_index=True))

    return sort


def _windows(length: int):
    """Segments of hot grams -> every window with a 128-bit name."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 1024):
            parts = batch["part"].tolist()
            data = np.frombuffer(b"".join(parts), dtype=np.uint8)
            sizes, nw = np.array([len(x) for x in parts]), batch["nw"].to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(parts)), nw)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(nw) - nw, nw)
            at = np.repeat(np.cumsum(sizes) - sizes, nw) + inside
            names = []
            for seed in (3, 4):
                prefix, down = _prefix_hash(data, seed), _tables(seed)[2]
                names.append(_mixed((prefix[at + length] - prefix[at]) * down[at]).view(np.int64))
            yield pd.DataFrame(
                {
                    "w1": names[0],
                    "w2": names[1],
                    "k1": batch["k1"].to_numpy()[row],
                    "k2": batch["k2"].to_numpy()[row],
                    "lo": batch["lo"].to_numpy()[row] + inside,
                    "n": batch["n"].to_numpy()[row],
                }
            )

    return named


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text ('' for null) and a 128-bit key of the text, so that equal texts are one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")
    )


def _packed(rows: DataFrame) -> DataFrame:
    """The text as compressed bytes: what is shuffled is a third of it."""

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            out = batch[["doc_id", "k1", "k2"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["z"] = [press.compress(x.encode("utf-8")) for x in batch["text"].tolist()]
            yield out

    return mapped(rows, squeeze, "doc_id long, k1 long, k2 long, z binary")


def _unpacked(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _cut_out(length: int):
    """Documents with the places of their unsettled segments -> the segments' bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 256):
            out = []
            for k1, k2, z, places in zip(batch["k1"], batch["k2"], batch["z"], batch["places"]):
                raw = _unpacked(z)
                for p in places:
                    part = raw[p["lo"] : p["lo"] + p["nw"] + length - 1]
                    out.append((k1, k2, p["lo"], p["nw"], p["rel"], p["gram"], p["n"], p["hot"], part))
            yield pd.DataFrame(out, columns=["k1", "k2", "lo", "nw", "rel", "gram", "n", "hot", "part"])

    return cut


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, lo, nw): the windows starting at lo to lo + nw - 1 of text (k1, k2) repeat somewhere.

    `rows` come from `keyed`. Ranges may overlap and repeat.
    """
    schema = "k1 long, k2 long, lo long, nw int, rel int, gram long, segment long"
    long_enough = rows.filter(F.octet_length("text") >= length).select("k1", "k2", "text")
    anchors = written(mapped(long_enough, _anchors(length, gram), schema), "anchors")

    # Counts are written before they are joined: two plain shuffles can be split where a gram is hot.
    grams = anchors.groupBy("gram").agg(
        F.count("*").alias("n"), (F.min("segment") == F.max("segment")).alias("settled")
    )
    grams = written(grams.filter("n > 1").select("gram", "settled"), "grams")
    shared = written(anchors.join(grams, "gram"), "shared-grams")
    settled = shared.filter("settled").select("k1", "k2", "lo", "nw")

    mixed = shared.filter("not settled")
    place = F.min(F.struct("k1", "k2", "lo", "nw", "rel")).alias("p")
    named = written(
        mixed.groupBy("gram", "segment").agg(F.count("*").alias("n"), place).select("gram", "segment", "n", "p.*"),
        "segments",
    )
    twice_named = written(named.filter("n > 1").select("gram", "segment"), "repeated-segments")
    again = mixed.join(twice_named, ["gram", "segment"], "left_semi")
    counted = again.select("k1", "k2", "lo", "nw")

    open_grams = named.groupBy("gram").agg(F.count("*").alias("segments"), F.min("n").alias("least"))
    open_grams = open_grams.filter("least = 1").select("gram", (F.col("segments") > MAX_SEGMENTS).alias("hot"))
    places = (
        named.join(written(open_grams, "open-grams"), "gram")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("lo", "nw", "rel", "gram", "n", "hot")).alias("places"))
    )
    texts = _packed(rows.filter(F.octet_length("text") >= length)).groupBy("k1", "k2").agg(F.first("z").alias("z"))
    part_schema = "k1 long, k2 long, lo long, nw int, rel int, gram long, n long, hot boolean, part binary"
    parts = written(
        mapped(texts.join(places, ["k1", "k2"]).select("k1", "k2", "z", "places"), _cut_out(length), part_schema),
        "segment-bytes",
    )
    range_schema = "k1 long, k2 long, lo long, nw int"
    dealt = parts.filter("not hot").repartition("gram").sortWithinPartitions("gram")
    induced = mapped(dealt, _sorted_runs(length), range_schema)

    name_schema = "w1 long, w2 long, k1 long, k2 long, lo long, n long"
    windows = mapped(parts.filter("hot"), _windows(length), name_schema)
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).filter("times > 1").select("w1", "w2")
    hot = windows.filter("n = 1").join(written(twice, "hot-windows"), ["w1", "w2"], "left_semi").select("k1", "k2", "lo", F.lit(1).alias("nw"))
    return settled.unionAll(counted).unionAll(induced).unionAll(hot)


def merged(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the ranges (lo, nw)."""
    out: list[tuple[int, int]] = []
    for lo, nw in sorted(ranges):
        stop = lo + nw + length - 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((lo, stop))
    return out


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs`: doc_id, k1, k2, z (the compressed text) and ranges, null if nothing repeats.

    A text that several rows share is covered as a whole; its ranges hold the one entry (-1, 0).
    """
    rows = keyed(docs)
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    marks = repeated_windows(rows, length, gram).unionAll(
        copies.select("k1", "k2", F.lit(-1).cast("long").alias("lo"), F.lit(0).alias("nw"))
    )
    # A text's ranges are no more than its anchors; equal ranges of copies fall together before the shuffle.
    ranges = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "nw")).alias("ranges"))
    ranges = ranges.withColumn(
        "ranges", F.when(F.exists("ranges", lambda r: r["lo"] < 0), F.slice(F.sort_array("ranges"), 1, 1)).otherwise(F.col("ranges"))
    )
    return _packed(rows).join(written(ranges, "ranges"), ["k1", "k2"], "left")


def spans_of(raw: bytes, ranges, length: int) -> list[tuple[int, int]]:
    """The maximal removed runs of a text."""
    if ranges is None or not len(ranges):
        return []
    pairs = [(r["lo"], r["nw"]) for r in ranges]
    if pairs[0][0] < 0:
        return [(0, len(raw))] if len(raw) >= length else []
    return merged(pairs, length)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_spans: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the spans).

    Null texts are empty; texts shorter than `length` bytes lose nothing. Rows with equal texts cover each other
    as a whole. A null doc_id stays null; an empty table gives no rows. Only doc_id and text are read, so other
    columns cannot clash.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 256):
            out = []
            for z, ranges in zip(batch["z"].tolist(), batch["ranges"].tolist()):
                raw = _unpacked(z)
                spans = spans_of(raw, ranges, length)
                rest = without(raw, spans)
                row = (len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
                out.append((*row, [{"start": a, "stop": b} for a, b in spans]) if with_spans else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans"] * with_spans]
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<start: long, stop: long>>" * with_spans
    return mapped(covered(docs, length).select("doc_id", "z", "ranges"), digest, schema)


def cleaned_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with the repeated bytes removed from text, and n_chars counted anew if there is such a column.

    A character that loses some of its bytes goes as a whole. The other columns are carried along.
    """
    ranges = covered(docs.select("doc_id", "text"), length).filter("ranges is not null").groupBy("k1", "k2")
    ranges = ranges.agg(F.first("ranges").alias("__ranges")).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(7), text)}
    flat = docs.withColumns(keys).join(ranges, ["__k1", "__k2"], "left").select(*[f"`{c}`" for c in docs.columns], "__ranges")

    docs_columns = docs.columns

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 256):
            texts = []
            for text, spans in zip(batch["text"].tolist(), batch["__ranges"].tolist()):
                raw = (text or "").encode("utf-8")
                cut = spans_of(raw, spans, length)
                texts.append(without(raw, cut).decode("utf-8", errors="ignore") if cut else text)
            out = batch[docs_columns].copy()
            out["text"] = texts
            if "n_chars" in docs_columns:
                out["n_chars"] = pd.array([None if t is None else len(t) for t in texts], dtype="Int64")
            yield out

    return mapped(flat, clean, docs.schema)
