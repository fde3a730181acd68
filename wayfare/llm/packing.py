"""Best-fit packing of token sequences after a dominance reduction (Martello and Toth).

What decides a packing is how many pieces there are of each length, and a length is at most the capacity. So the
plan is made on that histogram (at most `capacity` numbers, whatever the corpus holds), for whole classes at a time:

1. Reduction. A set of pieces that provably dominates every other set for its first piece is fixed for good:
   a piece beside which nothing fits; a pair that fills a sequence; the largest partner where only one more piece
   fits at all, or where it outweighs any two pieces that would fit instead.
2. Best-fit decreasing on what is left: each piece goes to the fullest sequence that can take it.

Both run on classes of equal pieces, so the plan has at most a few thousand rows. Spark then numbers the pieces
within (length, salt) and each task looks its pieces' places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import mapped, slices
from wayfare.llm.tokens import encoder
from wayfare.session import written

SALTS = 64  # groups in which the pieces of a length are numbered, at least
RANKED = 50_000  # pieces in such a group, about, where a length has more than SALTS times as many
Pattern = tuple[tuple[int, int], ...]  # (length, how many), in order of placement


class _Lengths:
    """Counts by length with the lengths that still have pieces in ascending order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = dict(counts)
        self.order = sorted(k for k, v in counts.items() if v > 0)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.order.pop(bisect_left(self.order, length))

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces left, one piece of length `without` set aside."""
        out: list[int] = []
        for length in self.order:
            left = self.counts[length] - (length == without)
            out += [length] * min(left, n - len(out))
            if len(out) == n:
                break
        return out

    def largest_up_to(self, room: int, without: int) -> int:
        """The largest piece of at most `room`, one piece of length `without` set aside; 0 if none."""
        at = bisect_right(self.order, room) - 1
        while at >= 0:
            length = self.order[at]
            if self.counts[length] - (length == without) > 0:
                return length
            at -= 1
        return 0

    def best_two(self, room: int, without: int) -> int:
        """The largest sum of two pieces within `room`."""
        usable = [x for x in self.order if x < room and self.counts[x] - (x == without) > 0]
        best, low, high = 0, 0, len(usable) - 1
        while low <= high:
            if low == high and self.counts[usable[low]] - (usable[low] == without) < 2:
                break
            total = usable[low] + usable[high]
            if total <= room:
                best = max(best, total)
                low += 1
            else:
                high -= 1
        return best


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sequences that are fixed because their set dominates all others, and the counts that remain."""
    left, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for length in sorted(left.order, reverse=True):
            while left.counts[length]:
                have, room = left.counts[length], capacity - length
                partner = left.largest_up_to(room, length) if room else 0
                if not partner:  # nothing fits beside it
                    n = have if length * 2 > capacity or have == 1 else 0
                    if not n:
                        break
                    fixed.append((((length, 1),), n))
                    left.take(length, n)
                    changed = True
                    continue
                two = left.smallest(2, length)
                if partner != room and len(two) == 2 and length + sum(two) <= capacity:
                    three = left.smallest(3, length)
                    if len(three) == 3 and length + sum(three) <= capacity:
                        break
                    if partner < left.best_two(room, length):
                        break
                if partner == length:
                    n = have // 2
                    fixed.append((((length, 2),), n))
                    left.take(length, 2 * n)
                else:
                    n = min(have, left.counts[partner])
                    fixed.append((((length, 1), (partner, 1)), n))
                    left.take(length, n)
                    left.take(partner, n)
                changed = True
    return fixed, {k: v for k, v in left.counts.items() if v}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, for all pieces of a length and all sequences with equal room at once."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no sequence can take it: open new ones
                each = capacity // length
                put(capacity - each * length, ((length, each),), todo // each)
                if todo % each:
                    put(capacity - todo % each * length, ((length, todo % each),), 1)
                todo = 0
                continue
            room = rooms[at]
            pattern, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            full = min(n, todo // each)
            put(room - each * length, (*pattern, (length, each)), full)
            todo -= full * each
            n -= full
            if n and todo and todo < each:
                put(room - todo * length, (*pattern, (length, todo)), 1)
                todo, n = 0, n - 1
            put(room, pattern, n)
    return [x for some in groups.values() for x in some]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: rows of (length, base, each, n_sequences, first_sequence, offset).

    The pieces of a length are taken in order of their rank; a row holds ranks base to base + each * n_sequences.
    """
    fixed, rest = reduced(counts, capacity)
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for pattern, n in fixed + best_fit(rest, capacity):
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, n, sequence, offset))
            used[length] += each * n
            offset += each * length
        sequence += n
    columns = ["length", "base", "each", "n_sequences", "first_sequence", "offset"]
    return pd.DataFrame(rows, columns=columns).astype("int64").sort_values(["length", "base"], ignore_index=True)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int, with_ids: bool) -> DataFrame:
    """The token pieces of every document; a null or empty text is the separator alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer_path).many, np.asarray([separator], dtype="<u4").tobytes()
        for batch in slices(batches, 1024):
            out, first = [], 0
            ids, stops = encode(batch["text"].tolist())
            for doc_id, stop in zip(batch["doc_id"].tolist(), stops.tolist()):
                data = ids[first:stop].tobytes() + end
                first = stop
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, dtype="<u4").astype("int32")) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece with its sequence and its place there.

    Null or empty texts are one piece with the separator. Repeated rows are packed as often as they occur; pieces
    of equal length are ranked by document and piece, and rows equal in all of that are interchangeable. An empty
    table gives no rows. Only doc_id and text are read, so other columns cannot clash. `with_ids` keeps the ids.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, capacity, separator, with_ids), "pieces")
    by_length = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # One row per length, so at most `capacity`; a common length is numbered in as many groups as its pieces need.
    salts = [(length, max(SALTS, -(-n // RANKED))) for length, n in by_length.items()]
    salts = F.broadcast(spark.createDataFrame(salts, "length long, salts long"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    cut = cut.join(salts, "length").withColumn("salt", salt).drop("salts")
    groups = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    shared = spark.sparkContext.broadcast(plan(by_length, capacity))  # at most a few thousand rows, see above

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("place", F.row_number().over(within) - 1)
        .join(firsts, ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("place"))
        .drop("first", "place", "salt")
    )

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        length, base = rows["length"].to_numpy(), rows["base"].to_numpy()
        starts = {int(x): i for i, x in reversed(list(enumerate(length)))}
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = np.zeros(len(batch), dtype="int64")
            for x in np.unique(size):
                here, first = size == x, starts[int(x)]
                last = first + int(np.searchsorted(length[first:], x, side="right"))
                row[here] = first + np.searchsorted(base[first:last], rank[here], side="right") - 1
            each = rows["each"].to_numpy()[row]
            inside = rank - base[row]
            batch["sequence_id"] = rows["first_sequence"].to_numpy()[row] + inside // each
            batch["offset"] = rows["offset"].to_numpy()[row] + inside % each * size
            yield batch.drop(columns="rank")

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return mapped(ranked.select(*names, "rank"), placed, schema + ", sequence_id long, offset long")
