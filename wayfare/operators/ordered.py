"""Ordered and keyed work that stays spread out when one key holds a third of the rows.

Spark's windows put a whole window partition into one task. Two ideas avoid that:

* `heavy_keys` finds the few keys above a row threshold from a mergeable sketch of the frequent items, one pass for
  all keys of a table, and counts only the candidates again. All other keys take Spark's own window or join. With no
  hot key the plan is Spark's own plan.
* Rows of hot keys (or of the whole table, for a global order) are cut into range slices by
  (key, order). A window runs inside each slice and a small table with one row per
  (key, slice) carries counts, sums or the last value over the slice borders.

That small table has at most `#keys + #slices` rows, because a range slice adds a row only where a
key crosses its border. There are at most rows / threshold hot keys; what depends on their number is broadcast
after counting it, and joined by a shuffle beyond BROADCAST_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import written

HOT_ROWS = 1_000_000  # rows a single task may hold for one key; spark.wayfare.hotRows overrides
TRACKED = 65_536  # items of a frequent-items sketch
MISSED = 8  # no key with more than MISSED / TRACKED of the rows of a sketch is ever missed; the bound is 3.5 / (TRACKED / 0.75) twice
TASK_ROWS = 125_000  # rows that one task sorts and groups by session; more rows make more tasks, not larger ones
FIT_ROWS = 500_000  # rows of a task of a fit, which reads them in every stage
BROADCAST_ROWS = 1_000_000  # hashes of hot keys sent to every executor: 8 MB
FIND = object()  # in place of hot keys: look for them
SLICE = "__slice"
PLACE, PLACE_BITS = "__place", 33
KEY_HASH = "__key_hash"


def row_threshold(df: DataFrame, hot_rows: int | None = None) -> int:
    named = df.sparkSession.conf.get("spark.wayfare.hotRows", str(HOT_ROWS))
    return int(named) if hot_rows is None else hot_rows


def dealt(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """`df` dealt by `keys` to as many partitions as its rows need, so that a task's memory does not grow with the input.

    A small table is left to Spark, which merges its partitions down to the number of cores at any size below.
    """
    parts = -(-df.count() // task_rows)
    few = parts <= df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if few else df.repartition(parts, *keys)


def dealt_evenly(df: DataFrame, keys: list[str], rows: int, task_rows: int = FIT_ROWS) -> DataFrame:
    """`df`, of about so many `rows`, dealt by `keys` to full rounds of all cores, for what reads it many times.

    Equal parts and a whole number of them per core: a fit of a thousand short stages waits for its largest task in each.
    """
    cores = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return df.repartition(cores * max(1, -(-rows // (cores * task_rows))), *keys)


def _sketched(rows: DataFrame, names: list[str], tracked: int) -> list[tuple[str, int, list]]:
    """(name, rows, frequent hashes with an upper bound of their rows) over all rows; one scan for all names."""
    sketch = [F.expr(f"approx_top_k_estimate(approx_top_k_accumulate(`{n}`, {tracked}), {tracked})").alias(n) for n in names]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *sketch).first()
    return [(n, found["n"], found[n] or []) for n in names]


def _sketched_parts(long: DataFrame, parts: int, tracked: int) -> list[tuple[str, int, list]]:
    """The same for long rows (name, hash), each name in `parts` parts with a sketch of its own."""
    item = f"approx_top_k_estimate(approx_top_k_accumulate(hash, {tracked}), {tracked})"
    by_part = long.groupBy("name", F.pmod(F.hash("hash"), F.lit(parts)).alias("part"))
    found = by_part.agg(F.count(F.lit(1)).alias("n"), F.expr(item).alias("items")).collect()
    return [(r["name"], r["n"], r["items"]) for r in found]


def heavy_keys(
    df: DataFrame, keys: dict[str, list[str]], hot_rows: int | None = None, tracked: int = TRACKED
) -> DataFrame:
    """(name, hash, rows) of every key with more than `hot_rows` rows, for several keys of one table.

    A sketch of `tracked` items misses no key with more than MISSED / tracked of its rows. While that share is above the
    threshold for some rows, the candidates so far are set aside and the rest is sketched again in more parts, so
    every threshold is met exactly. Candidates, a bounded number per sketch, are counted again in one scan; without
    one there is no second scan. Two keys with one hash are both treated as hot, which is slower but not wrong.
    """
    spark = df.sparkSession
    threshold = row_threshold(df, hot_rows)
    hashed = df.select(*[F.xxhash64(*columns).alias(name) for name, columns in keys.items()])

    def long(names: list[str]) -> DataFrame:
        return hashed.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("hash")) for n in names])))

    def table(pairs: set[tuple[str, int]]) -> DataFrame:
        return spark.createDataFrame(sorted(pairs), "name string, hash long")

    if threshold < 1:  # every key: nothing to leave out
        counted = long(list(keys)).groupBy("name", "hash").agg(F.count(F.lit(1)).alias("rows"))
        return written(counted, "heavy-keys")
    candidates: set[tuple[str, int]] = set()
    found, parts = _sketched(hashed, list(keys), tracked), 1
    while True:
        new = {(name, item["item"]) for name, _, items in found for item in items if item["count"] > threshold}
        open_names = sorted({name for name, n, _ in found if MISSED * n > threshold * tracked})
        candidates |= new
        if not open_names:
            break
        most = max(n for name, n, _ in found if name in open_names)
        parts *= max(2, -(-MISSED * most // (threshold * tracked)))
        rest = long(open_names)
        if candidates:
            rest = rest.join(F.broadcast(table(candidates)), ["name", "hash"], "left_anti")
        found = _sketched_parts(rest, parts, tracked)
    if not candidates:
        return spark.createDataFrame([], "name string, hash long, rows long")
    # Candidates are at most MISSED / threshold of all rows; they are counted before they are sent anywhere.
    names = sorted({name for name, _ in candidates})
    listed = table(candidates)
    listed = F.broadcast(listed) if len(candidates) <= BROADCAST_ROWS else listed
    counted = long(names).join(listed, ["name", "hash"], "left_semi").groupBy("name", "hash").agg(F.count(F.lit(1)).alias("rows"))
    return written(counted.filter(F.col("rows") > threshold), "heavy-keys")


def keys_named(heavy: DataFrame, name: str) -> DataFrame | None:
    """The hashes of one key out of `heavy_keys`, or None when there are none."""
    found = heavy.filter(F.col("name") == name).select(F.col("hash").alias(KEY_HASH))
    return None if found.isEmpty() else found


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """Hashes of the keys with more than `hot_rows` rows, or None when there are none."""
    return keys_named(heavy_keys(df, {"key": keys}, hot_rows), "key")


def sent(small: DataFrame, hot: DataFrame) -> DataFrame:
    """`small`, with about one row per hot key, broadcast if the hot keys are few enough."""
    return F.broadcast(small) if hot.count() <= BROADCAST_ROWS else small


def split_hot(
    df: DataFrame, keys: list[str], hot: DataFrame | None
) -> tuple[DataFrame | None, DataFrame]:
    """(rows of hot keys or None, all other rows)."""
    if hot is None:
        return None, df
    hashed = df.withColumn(KEY_HASH, F.xxhash64(*keys))
    listed = sent(hot, hot)
    return (
        hashed.join(listed, KEY_HASH, "left_semi").drop(KEY_HASH),
        hashed.join(listed, KEY_HASH, "left_anti").drop(KEY_HASH),
    )


def _sliced(df: DataFrame, keys: list[str], order: list[Column], slices: int | None) -> DataFrame:
    """Cut `df` into range slices by (keys, order); the written copy fixes the slice numbers.

    Without a number of slices the shuffle partitions are used, merged by AQE where they are small.
    """
    count = [] if slices is None else [slices]
    ranged = df.repartitionByRange(*count, *keys, *order)
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _on_edges(sliced: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the per-slice row to each row. `edges` is bounded, see the module text."""
    match = [sliced[SLICE] == edges["__e_slice"]]
    match += [sliced[k].eqNullSafe(edges[f"__e_{k}"]) for k in keys]
    joined = sliced.join(F.broadcast(edges), match, "inner")
    return joined.drop("__e_slice", *[f"__e_{k}" for k in keys])


def _edges(sliced: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return sliced.groupBy(
        F.col(SLICE).alias("__e_slice"), *[F.col(k).alias(f"__e_{k}") for k in keys]
    ).agg(*aggregates)


def _edge_window(keys: list[str]):
    """Slices of one key in order: at most as many rows as there are slices."""
    names = [f"__e_{k}" for k in keys]
    return (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("__e_slice")


def _inner_window(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def number_sliced(
    df: DataFrame, keys: list[str], order: list[Column], name: str, slices: int | None = None
) -> DataFrame:
    """1-based row number of each row within `keys` by `order`, over range slices.

    `order` must be a total order within a key. `keys` may be empty for a global number. Rows move once: each slice is
    sorted where it is written, so a row's place in it is known and needs no window afterwards.
    """
    count = [] if slices is None else [slices]
    ranged = df.repartitionByRange(*count, *keys, *order).sortWithinPartitions(*keys, *order)
    # Spark's id holds the partition above PLACE_BITS bits and the place inside the partition below.
    placed = written(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "slices")
    inside = F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sliced = placed.withColumns({SLICE: F.shiftright(PLACE, PLACE_BITS), PLACE: inside})
    before = _edge_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = _edges(sliced, keys, [F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias("__first")])
    edges = edges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = _on_edges(sliced, edges, keys).withColumn(name, F.col(PLACE) - F.col("__first") + F.col("__before") + 1)
    return numbered.drop(SLICE, PLACE, "__first", "__before")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
    hot: DataFrame | None,
    slices: int | None = None,
) -> DataFrame:
    """`row_number() over (partition by keys order by order)`; `hot` comes from `hot_keys`."""
    hot, cold = split_hot(df, keys, hot)
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    if hot is None:
        return numbered
    return numbered.unionByName(number_sliced(hot, keys, order, name, slices))


def previous_sliced(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """`lag(value) over (partition by keys order by order)` over range slices.

    A slice's first row takes the last value of the slice before. `order` is a list of ascending plain
    columns and a total order within a key.
    """
    sliced = _sliced(df, keys, order, slices)
    # Wrapped, so that a NULL value is not skipped by max_by.
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")
    edges = _edges(sliced, keys, [last])
    edges = edges.withColumn("__carry", F.lag("__last").over(_edge_window(keys))["v"]).drop("__last")
    inner = _inner_window(keys, order)
    first = F.row_number().over(inner) == 1
    return (
        _on_edges(sliced, edges, keys)
        .withColumn(name, F.when(first, F.col("__carry")).otherwise(F.lag(value).over(inner)))
        .drop(SLICE, "__carry")
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Running sums (rows up to and including this one) and grand totals per key.

    For each `{column: name}` adds `name` and `name_total`. Used with `keys=[]` for a global order,
    where a plain window would run in a single task, or with a few groups.
    """
    sliced = _sliced(df, keys, order, slices)
    ordered = _edge_window(keys)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = _edges(sliced, keys, [F.sum(c).alias(f"__s_{n}") for c, n in sums.items()])
    for name in sums.values():
        edges = edges.withColumn(
            f"__b_{name}", F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0))
        ).withColumn(f"{name}_total", F.sum(f"__s_{name}").over(whole))
    edges = edges.drop(*[f"__s_{n}" for n in sums.values()])
    joined = _on_edges(sliced, edges, keys)
    inner = _inner_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for column, name in sums.items():
        joined = joined.withColumn(name, F.sum(column).over(inner) + F.col(f"__b_{name}"))
    return joined.drop(SLICE, *[f"__b_{n}" for n in sums.values()])


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles, one row per group of `by` (few groups) or one row overall.

    Equal values are counted first (with map-side combine), so hot values cost one row each; the
    rest is a running total over distinct values. No task holds a whole group, as `percentile` would.
    An empty input gives one row of NULLs without `by`, and no row with it.
    """
    by = by or []
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    run = running_totals(counted, by, [F.col("__v")], {"__n": "__upto"}, slices)
    rank = {name: (F.col("__upto_total") - 1) * F.lit(float(q)) for name, q in probs.items()}
    first_rank, last_rank = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
    picked = []
    for name, position in rank.items():
        for side, target in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (first_rank <= target) & (target <= last_rank)
            picked.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{name}_{side}"))
        picked.append(F.max(position - F.floor(position)).alias(f"__{name}_part"))
    found = run.groupBy(*by).agg(*picked)
    return found.select(
        *by,
        *[
            (
                F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_part")
            ).alias(n)
            for n in probs
        ],
    )


def join_unique(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """Join where `small` has at most one row per key and `big` may hold hot keys.

    `hot` comes from `hot_keys` over the keys of `big`. Hot rows meet a broadcast of only the hot part of
    `small` (one row per hot key, plus hash twins, counted before); the rest is an ordinary join.
    `how` is "left" or "inner"; `condition` may name columns of both sides.
    """

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.select(
            *[F.col(k).alias(f"__r_{k}") for k in keys],
            *[c for c in right.columns if c not in keys],
        )
        match = [F.col(k) == F.col(f"__r_{k}") for k in keys]
        if condition is not None:
            match.append(condition)
        return left.join(renamed, match, how).drop(*[f"__r_{k}" for k in keys])

    hot_big, cold_big = split_hot(big, keys, hot)
    result = joined(cold_big, small)
    if hot_big is None:
        return result
    hot_small, _ = split_hot(small, keys, hot)
    return result.unionByName(joined(hot_big, sent(hot_small, hot)))
