"""Exact quantiles of many measures and groups at once, by refining histograms.

Ranks are selected, not sorted for: one pass counts the values of every group, and each further pass counts the bins of
the interval that holds a wanted rank, until all values of the interval are equal. Bins carry their least and
greatest value, so hot values end the search at once. All measures and groups share each pass; a pass sends a bounded
number of bins per open interval, whatever the data holds, and nothing is written or sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
_STEEP = float(1 << 40)  # how far the bins of every second pass are drawn together at the lower end


@dataclass
class Interval:
    """Values from `low` to `high` of one group, `below` values being less; holds the wanted `ranks`."""

    group: str
    low: float
    high: float
    below: int
    ranks: list[int]


def _position(value: Column, interval: Interval, even: bool) -> Column:
    """Where a value lies in its interval, from 0 to 1; every second time the lower end is looked at closely."""
    low, high = interval.low, interval.high
    if math.isfinite(high - low):  # never zero: neighbouring numbers differ by a number
        share = (value - F.lit(low)) / F.lit(high - low)
    else:
        share = (value / F.lit(2.0) - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    return share if even else F.log1p(share * F.lit(_STEEP)) / F.lit(math.log1p(_STEEP))


def _refined(rows: DataFrame, group: str, value: str, intervals: list[Interval], bins: int, even: bool) -> list[Interval]:
    v, place = F.col(value), None
    for i, x in enumerate(intervals):
        here = (F.col(group) == x.group) & (v >= x.low) & (v <= x.high)
        bin_ = F.least(F.lit(bins - 1), F.floor(_position(v, x, even) * bins).cast("int"))
        # The ends have bins of their own, so each pass leaves one of them behind.
        bin_ = F.when(v == x.low, -1).when(v == x.high, bins).otherwise(bin_)
        struct = F.struct(F.lit(i).alias("i"), bin_.alias("bin"))
        place = F.when(here, struct) if place is None else place.when(here, struct)
    counted = rows.select(place.alias("at"), v.alias("v")).filter("at is not null").groupBy("at.i", "at.bin")
    found: dict[int, list] = {}
    # At most `bins` + 2 rows per interval, and there are at most two intervals per group and quantile.
    for r in counted.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        found.setdefault(r["i"], []).append(r)
    out = []
    for i, x in enumerate(intervals):
        below, ranks = x.below, sorted(x.ranks)
        for r in sorted(found[i], key=lambda r: r["bin"]):
            inside = [k for k in ranks if below <= k < below + r["n"]]
            if inside:
                out.append(Interval(x.group, r["low"], r["high"], below, inside))
            below += r["n"]
    return out


def select_ranks(
    rows: DataFrame, group: str, value: str, wanted: dict[str, list[int]], ends: dict[str, tuple[float, float]], bins: int = BINS
) -> dict[tuple[str, int], float]:
    """The values of the wanted ranks (from 0) of finite values; `ends` has each group's least and greatest value."""
    intervals = [Interval(g, *ends[g], 0, sorted(set(ranks))) for g, ranks in wanted.items() if ranks]
    found, even = {}, True
    while intervals:
        found |= {(x.group, k): x.low for x in intervals if x.low == x.high for k in x.ranks}
        intervals = [x for x in intervals if x.low != x.high]
        if intervals:
            intervals = _refined(rows, group, value, intervals, bins, even)
            even = not even
    return found


def quantiles_by_group(rows: DataFrame, group: str, value: str, probs: dict[str, float], bins: int = BINS) -> DataFrame:
    """Exact interpolated quantiles, one row per group: the group and one column per name in `probs`.

    `group` is text and there are few groups; NULL values, NaN and rows without a group count as no value. Runs one
    counting pass and a few refining ones when called.
    """
    v = F.col(value).cast("double")
    known = rows.select(F.col(group).alias("g"), v.alias("v")).filter("g is not null and v is not null and not isnan(v)")
    infinite = F.lit(float("inf"))
    finite = F.when(F.abs("v") < infinite, F.col("v"))
    ends = known.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("v") == -infinite).alias("n_low"),
        F.count_if(F.col("v") == infinite).alias("n_high"),
        F.min(finite).alias("low"),
        F.max(finite).alias("high"),
    )
    sizes = {r["g"]: r for r in ends.collect()}  # few groups
    places = {(g, name): (r["n"] - 1) * float(q) for g, r in sizes.items() for name, q in probs.items()}

    def at(r, rank: int) -> float | int:
        """An infinity, or the rank among the finite values."""
        if rank < r["n_low"]:
            return -math.inf
        return math.inf if rank >= r["n"] - r["n_high"] else rank - r["n_low"]

    wanted: dict[str, list[int]] = {g: [] for g in sizes}
    for (g, _), place in places.items():
        wanted[g] += [k for k in (at(sizes[g], f(place)) for f in (math.floor, math.ceil)) if isinstance(k, int)]
    found = select_ranks(known, "g", "v", wanted, {g: (r["low"], r["high"]) for g, r in sizes.items() if r["low"] is not None}, bins)

    def value_at(g: str, rank: int) -> float:
        k = at(sizes[g], rank)
        return found[g, k] if isinstance(k, int) else k

    out = []
    for g in sorted(sizes):
        row = [g]
        for name in probs:
            place = places[g, name]
            low, high = value_at(g, math.floor(place)), value_at(g, math.ceil(place))
            row.append(low if low == high else low + (high - low) * (place - math.floor(place)))
        out.append(tuple(row))
    schema = ", ".join([f"`{group}` string", *(f"`{name}` double" for name in probs)])
    return rows.sparkSession.createDataFrame(out, schema)
