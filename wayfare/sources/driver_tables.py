"""Adapter: the given test tables -> the three raw clickstream tables.

The mapping plants the known faults of front-end tracking (copies, double fires, file order that is not
time order, orphan SKUs, phantom clicks, empty results) by arithmetic, so that any engine can repeat it.
See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.ordered import dealt

# Fixed values of the adapter.
BLOCK = 1024  # file order is scrambled inside blocks of this many events
STRIDE = 389  # odd, so that i -> i * 389 mod 1024 is one-to-one
COPY_EVERY = 50
RANGE = 100  # each group of ten users browses and searches its own hundred SKUs; bounds every result list
PHANTOM_SKU = "phantom"
SEARCH_START_MS = 1_704_067_200_000
TASK_LINES = 500_000  # lines of orders that one task groups; more lines make more tasks, not larger ones


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_browsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a browsing log: user-days are sessions, times are cut to the hour.

    The SKU is the event's number k inside the hundred SKUs of the user's group, so SKUs grow with users.
    """
    place = F.col("event_id")
    scrambled = place - place % BLOCK + (place * STRIDE) % BLOCK
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", "detail")
        .when(kind == "click", "add")
        .when(kind == "purchase", "purchase")
        .when(kind == "error", "remove")
    )
    sku = F.expr(f"user_id div 10 * {RANGE}") + F.get_json_object("props", "$.k").cast("bigint")
    # Date and hour of a zone-free timestamp depend on no session setting.
    day = F.col("ts").cast("date")
    ms = F.unix_date(day).cast("bigint") * c.DAY_MS + F.hour("ts").cast("bigint") * c.HOUR_MS
    date = F.replace(day.cast("string"), F.lit("-"), F.lit(""))
    copies = F.when(scrambled % COPY_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", kind, "props", ms.alias("ms"), date.alias("date"), F.explode(copies).alias("copy"))
        .select(
            (2 * scrambled + F.col("copy")).alias("file_row_idx"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"), "date").alias("session_id_hash"),
            F.when(kind == "signup", "pageview").otherwise("event_product").alias("event_type"),
            action.alias("product_action"),
            F.when(kind != "signup", sku.cast("string")).alias("product_sku_hash"),
            F.col("ms").alias("server_timestamp_epoch_ms"),
            F.when(place % 10 != 9, (F.col("user_id") % 7).cast("string")).alias("hashed_url"),
        )
    )


def raw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as queries; the SKUs of the order's lines, by first line, as the result list.

    Lines are merged to one row per (order, place in the hundred) before any list is built, so a list holds
    at most RANGE entries however many lines an order has. They move once, by order: both groupings and the join
    with the orders find them together. A customer searches as user `o_custkey div 10`.
    """
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % RANGE).alias("sku"), "l_linenumber", returned.alias("returned")
    )
    entries = dealt(lines, ["l_orderkey"], TASK_LINES).groupBy("l_orderkey", "sku").agg(
        F.min("l_linenumber").alias("place"), F.max("returned").alias("clicked")
    )
    # `sort_array` compares structs itself; `array_sort` would call a comparator for every pair.
    lists = entries.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("place", "sku", "clicked"))).alias("entries")
    )
    key = F.col("o_orderkey")
    group = F.expr(f"o_custkey div 100 * {RANGE}")
    none = F.array().cast("array<string>")

    def named(entries: F.Column) -> F.Column:
        return F.transform(entries, lambda e: (e["sku"] + group).cast("string"))

    shown = named(F.col("entries"))
    chosen = F.coalesce(named(F.filter("entries", lambda e: e["clicked"])), none)
    clicks = F.concat(chosen, F.when(key % 20 == 0, F.array(F.lit(PHANTOM_SKU))).otherwise(none))
    day = 1 + key % 30
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey")
        .join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            key.alias("file_row_idx"),
            F.concat(
                F.expr("o_custkey div 10").cast("string"),
                F.lit("-202401"),
                F.lpad(day.cast("string"), 2, "0"),
            ).alias("session_id_hash"),
            (SEARCH_START_MS + (key % 30) * c.DAY_MS + (key % 24) * c.HOUR_MS).alias(
                "server_timestamp_epoch_ms"
            ),
            shown.alias("product_skus"),
            F.when(F.array_size(clicks) > 0, clicks).alias("clicked_skus"),
        )
    )


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as the catalog: even keys carry no attributes, every fifth part is listed under another
    number than the one browsed, so both unlisted SKUs and never-browsed catalog rows exist."""
    key = F.col("p_partkey")
    third = F.when(key % 3 == 0, F.concat(F.lit("/"), F.col("p_name"))).otherwise("")
    path = F.when(key % 2 != 0, F.concat("p_type", F.lit("/"), "p_brand", third))
    bucket = F.when(key % 2 != 0, (1 + F.expr("p_partkey div 10") % 10).cast("double"))
    number = key.cast("string")
    described = table(spark, sf_dir, "part").select(
        F.when(key % 5 == 0, F.concat(F.lit("new-"), number)).otherwise(number).alias("product_sku_hash"),
        path.alias("category_hash"),
        bucket.alias("price_bucket"),
    )
    return with_hierarchy(described)


def with_hierarchy(catalog: DataFrame) -> DataFrame:
    """Add the split category path; the column order of the raw catalog."""
    return catalog.withColumns(c.hierarchy("category_hash")).select(
        "product_sku_hash",
        "category_hash",
        "category_path",
        "category_lvl1",
        "category_lvl2",
        "category_lvl3",
        "category_depth",
        "price_bucket",
    )
