"""Row-level parity of two tables: order-free digests of buckets, descending only into buckets that differ.

Rows are dealt to buckets by a hash of their key. A bucket's digest is its number of rows, the sum of its rows'
hashes and the exclusive-or of a second hash: it does not depend on order, is combined before the shuffle, and
differs where a row was lost, added or changed. Equal tables cost one narrow aggregate a side. Where buckets differ,
their rows alone are dealt to finer buckets, and only the rows of the last buckets that differ are grouped by key and
compared column by column; the tables as a whole are never joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import written

BITS = 10  # each step deals a bucket to 1,024 finer ones
LEAF_ROWS = 1_000_000  # so many rows in differing buckets are compared by key without a further step
DEPTH = 4


def _known(names: list[str]) -> list[Column]:
    """Values with their null flags: a hash alone passes over nulls."""
    return [x for n in names for x in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _placed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with a hash of their key and two of all their columns."""
    return df.select(
        *[F.col(f"`{n}`") for n in columns],
        F.xxhash64(*_known(keys)).alias("__place"),
        F.xxhash64(*_known(columns)).alias("__row"),
        F.hash(*_known(columns)).alias("__row2"),
    )


def _bucket(depth: int) -> Column:
    return F.shiftrightunsigned("__place", 64 - BITS * depth).alias("__bucket")


def digests(placed: DataFrame, depth: int = 1) -> DataFrame:
    """(__bucket, n, total, parity) of rows with hashes; one row per bucket."""
    return placed.groupBy(_bucket(depth)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_wide(F.col("__row"))).alias("total"), F.bit_xor("__row2").alias("parity")
    )


def differing_buckets(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """(__bucket, n): buckets whose digests differ, with the rows of the larger side."""
    a, b = digests(left, depth), digests(right, depth)
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in ("n", "total", "parity")])
    n = F.greatest(F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0)))
    bucket = F.coalesce(a["__bucket"], b["__bucket"]).alias("__bucket")
    return a.join(b, a["__bucket"] == b["__bucket"], "full").filter(~same).select(bucket, n.alias("n"))


def differences(
    left: DataFrame, right: DataFrame, keys: list[str], leaf_rows: int = LEAF_ROWS, depth: int = DEPTH
) -> DataFrame:
    """The keys whose rows differ: the key, n_left, n_right, kind (missing, extra or changed) and the columns.

    Both tables need the same columns, in any order. A key may repeat: its rows are compared as a whole, as multisets.
    NULL keys are keys. `columns` lists the changed columns of keys that both sides hold, comma separated.
    """
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(right.columns))}")
    a, b = _placed(left, keys, columns), _placed(right, keys, columns)
    for step in range(1, depth + 1):
        found = written(differing_buckets(a, b, step), "parity-buckets")
        # Rows of equal buckets are left behind; the scans read them once a step and move none of them.
        a, b = (x.withColumn("__bucket", _bucket(step)).join(found.select("__bucket"), "__bucket", "left_semi").drop("__bucket") for x in (a, b))
        if (found.agg(F.sum("n")).first()[0] or 0) <= leaf_rows:
            break
    return _compared(a, b, keys, columns)


def _compared(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    others = [n for n in columns if n not in keys]

    def by_key(df: DataFrame, side: str) -> DataFrame:
        sums = [F.sum(_wide(F.xxhash64(*_known([n])))).alias(f"{side}_{i}") for i, n in enumerate(others)]
        whole = F.sum(_wide(F.col("__row"))).alias(f"{side}_row")
        named = [F.col(f"`{k}`").alias(f"{side}_key{i}") for i, k in enumerate(keys)]
        return df.groupBy(*named).agg(F.count(F.lit(1)).alias(f"{side}_n"), whole, *sums)

    x, y = by_key(a, "__l"), by_key(b, "__r")
    match = [x[f"__l_key{i}"].eqNullSafe(y[f"__r_key{i}"]) for i in range(len(keys))]
    both = x.join(y, match, "full")
    differ = [F.when(F.col(f"__l_{i}") != F.col(f"__r_{i}"), F.lit(n)) for i, n in enumerate(others)]
    n_left, n_right = (F.coalesce(F.col(f"{side}_n"), F.lit(0)).alias(name) for side, name in (("__l", "n_left"), ("__r", "n_right")))
    kind = F.when(F.col("__r_n").isNull(), "missing").when(F.col("__l_n").isNull(), "extra").otherwise("changed")
    named = [F.when(F.col("__l_n").isNull(), F.col(f"__r_key{i}")).otherwise(F.col(f"__l_key{i}")).alias(k) for i, k in enumerate(keys)]
    changed = F.when(kind == "changed", F.concat_ws(",", *differ)).otherwise("")
    unequal = ~(F.col("__l_n").eqNullSafe(F.col("__r_n")) & F.col("__l_row").eqNullSafe(F.col("__r_row")))
    return both.filter(unequal).select(*named, n_left, n_right, kind.alias("kind"), changed.alias("columns"))
