"""Staging: duplicates, the detail/pageview double fire, sequencing, search rows, the product dimension.

Ordinary sessions need one wide shuffle: `repartition(session)` satisfies the clustering of the
six-column grouping and of every window below, so nothing moves again. Sessions above the row
threshold (see `ordered`) take a path in which each step spreads over the cluster.

Distinctness inside a session is resolved here, while the rows of a session lie together: each
event knows whether it is the first of its (stage, SKU) and of its page, and which add-to-cart
came first. Session, product and cart tables then need only sums, never `count(DISTINCT)` or a join
back to the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.ordered import dealt, hot_keys, keys_named, number_sliced, sent, split_hot
from wayfare.session import written

SESSION = "session_id_hash"
TS = "server_timestamp_epoch_ms"
INSTANT = [SESSION, TS, "hashed_url"]

STAGED_COLUMNS = [
    SESSION,
    "event_type",
    "product_action",
    "product_sku_hash",
    "hashed_url",
    TS,
    "event_ts",
    "event_seq",
    "day_of_week",
    "hour_of_day",
    "funnel_stage",
    "raw_row_count",
    "file_row_idx",
]
# Resolved once per session for the tables downstream.
HELPER_COLUMNS = ["first_of_stage_sku", "first_of_url", "cart_seq", "cart_ts", "cart_sku"]


def usable_events(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col(SESSION).isNotNull() & F.col(TS).isNotNull())


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per distinct event: the first file position and the number of copies.

    A plain grouping: copies are merged before the shuffle, so a flood of copies costs one row per task.
    """
    return events.groupBy(*c.EVENT_COLUMNS).agg(
        F.min("file_row_idx").alias("file_row_idx"),
        F.count(F.lit(1)).alias("raw_row_count"),
    )


def dedup_events_by_fingerprint(events: DataFrame) -> DataFrame:
    """The same result in two stages: by a 64-bit fingerprint alone, then by all columns where fingerprints collide.

    The first stage groups, sorts and compares eight bytes instead of six columns, and carries the least and the greatest
    event of a fingerprint. Where they are equal the group is one event. Only fingerprints of several events, next to
    none, are grouped again by all columns.
    """
    event = F.struct(*c.EVENT_COLUMNS)
    hashed = events.withColumn("__fp", c.fingerprint(c.EVENT_COLUMNS))
    first = hashed.groupBy("__fp").agg(
        F.min(event).alias("__least"),
        F.max(event).alias("__most"),
        F.min("file_row_idx").alias("file_row_idx"),
        F.count(F.lit(1)).alias("raw_row_count"),
    )
    first = written(first, "fingerprints")
    alone = first.filter("__least <=> __most").select("__least.*", "file_row_idx", "raw_row_count")
    several = first.filter("not (__least <=> __most)").select("__fp")
    if several.isEmpty():
        return alone
    return alone.unionByName(dedup_events(hashed.join(several, "__fp", "left_semi").drop("__fp")))


def _may_repeat() -> Column:
    """Only a pageview with a known URL can repeat a detail; a NULL event type is neither here nor dropped."""
    pageview = (F.col("event_type") == "pageview") & F.col("hashed_url").isNotNull()
    return F.coalesce(pageview, F.lit(False))


def collapse_double_fire(deduped: DataFrame) -> DataFrame:
    """Drop pageviews with a `detail` at the same session, millisecond and URL.

    A window over the instant: with the rows already together by session it moves nothing.
    """
    detail = F.max(F.when(F.col("product_action") == "detail", 1).otherwise(0)).over(
        Window.partitionBy(*INSTANT)
    )
    marked = deduped.withColumn("__paired", _may_repeat() & (detail == 1))
    return marked.filter(~F.col("__paired")).drop("__paired")


def collapse_double_fire_spread(deduped: DataFrame) -> DataFrame:
    """The same without gathering an instant: candidates meet one row per instant that has a detail."""
    details = deduped.filter((F.col("product_action") == "detail") & F.col("hashed_url").isNotNull())
    kept = deduped.filter(_may_repeat()).join(details.select(*INSTANT).distinct(), INSTANT, "left_anti")
    return kept.unionByName(deduped.filter(~_may_repeat()))


def describe_events(events: DataFrame) -> DataFrame:
    """Funnel stage and UTC time features; row-wise."""
    return events.withColumns(
        {
            "event_ts": c.event_time(TS),
            "day_of_week": c.day_of_week(TS),
            "hour_of_day": c.hour_of_day(TS),
            "funnel_stage": c.funnel_stage(),
        }
    )


def _cart_fields(anchor: Column) -> dict[str, Column]:
    return {"cart_seq": anchor["seq"], "cart_ts": anchor["ts"], "cart_sku": anchor["sku"]}


def _first_add() -> Column:
    return F.min(
        F.when(
            F.col("funnel_stage") == "add_to_cart",
            F.struct(
                F.col("event_seq").alias("seq"),
                F.col(TS).alias("ts"),
                F.col("product_sku_hash").alias("sku"),
            ),
        )
    )


def _stage_ordinary(events: DataFrame, parts: int | None = None) -> DataFrame:
    by_parts = dealt(events, [SESSION]) if parts is None else events.repartition(parts, SESSION)
    together = describe_events(collapse_double_fire(dedup_events(by_parts)))
    by_session = Window.partitionBy(SESSION)
    in_order = by_session.orderBy(TS, "file_row_idx")
    sequenced = together.withColumn("event_seq", F.row_number().over(in_order).cast("bigint"))
    anchored = sequenced.withColumn("__anchor", _first_add().over(by_session))
    sku_first = F.row_number().over(
        Window.partitionBy(SESSION, "funnel_stage", "product_sku_hash").orderBy("event_seq")
    )
    url_first = F.row_number().over(Window.partitionBy(SESSION, "hashed_url").orderBy("event_seq"))
    return anchored.withColumns(
        {
            "first_of_stage_sku": F.col("product_sku_hash").isNotNull() & (sku_first == 1),
            "first_of_url": F.col("hashed_url").isNotNull() & (url_first == 1),
            **_cart_fields(F.col("__anchor")),
        }
    ).select(*STAGED_COLUMNS, *HELPER_COLUMNS)


def _stage_hot(events: DataFrame, hot: DataFrame, slices: int | None) -> DataFrame:
    described = describe_events(collapse_double_fire_spread(dedup_events(events)))
    order = [F.col(TS), F.col("file_row_idx")]
    # Read four times below.
    sequenced = written(number_sliced(described, [SESSION], order, "event_seq", slices), "hot-events")

    def firsts(column: str, extra: list[str], name: str) -> DataFrame:
        # One row per distinct value, merged before the shuffle; (session, seq) names one event.
        return (
            sequenced.filter(F.col(column).isNotNull())
            .groupBy(SESSION, *extra, column)
            .agg(F.min("event_seq").alias("event_seq"))
            .select(SESSION, "event_seq", F.lit(True).alias(name))
        )

    # One row per hot session.
    anchors = sequenced.groupBy(SESSION).agg(_first_add().alias("__anchor"))
    place = [SESSION, "event_seq"]
    return (
        sequenced.join(firsts("product_sku_hash", ["funnel_stage"], "__sku"), place, "left")
        .join(firsts("hashed_url", [], "__url"), place, "left")
        .join(sent(anchors, hot), SESSION, "left")
        .withColumns(
            {
                "first_of_stage_sku": F.coalesce("__sku", F.lit(False)),
                "first_of_url": F.coalesce("__url", F.lit(False)),
                **_cart_fields(F.col("__anchor")),
            }
        )
        .select(*STAGED_COLUMNS, *HELPER_COLUMNS)
    )


def stage_parts(
    raw_browsing: DataFrame, hot: DataFrame | None, slices: int | None = None, parts: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(events of ordinary sessions, events of hot sessions or None), clean and in a deterministic order.

    With `parts` the ordinary sessions are dealt to so many partitions by session, as a bucketed table wants them.
    """
    events = usable_events(raw_browsing).select(*c.EVENT_COLUMNS, "file_row_idx")
    large, ordinary = split_hot(events, [SESSION], hot)
    staged = _stage_ordinary(ordinary, parts)
    return staged, None if large is None else _stage_hot(large, hot, slices)


def stage_browsing(
    raw_browsing: DataFrame,
    hot_rows: int | None = None,
    slices: int | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Clean events in a deterministic order, with the helper columns of this module.

    `heavy` is the result of `heavy_keys` over the raw log with the session as "session", if it is known already.
    """
    if heavy is None:
        hot = hot_keys(usable_events(raw_browsing), [SESSION], hot_rows)
    else:
        hot = keys_named(heavy, "session")
    staged, large = stage_parts(raw_browsing, hot, slices)
    return staged if large is None else staged.unionByName(large)


def stage_search(raw_search: DataFrame) -> DataFrame:
    """One row per query: result and click lists, counts, the clicks that belong to the result list."""
    none = F.array().cast("array<string>")
    lists = usable_events(raw_search).withColumns(
        {
            "result_skus": F.coalesce("product_skus", none),
            "clicked_skus": F.coalesce("clicked_skus", none),
        }
    )
    hits = F.filter("clicked_skus", lambda sku: F.array_contains("result_skus", sku))
    misses = F.filter("clicked_skus", lambda sku: ~F.array_contains("result_skus", sku))
    return lists.select(
        SESSION,
        TS,
        c.event_time(TS).alias("event_ts"),
        "result_skus",
        "clicked_skus",
        F.array_size("result_skus").cast("bigint").alias("n_results"),
        F.array_size("clicked_skus").cast("bigint").alias("n_clicks"),
        (F.array_size("result_skus") == 0).alias("is_zero_result"),
        F.array_size(misses).cast("bigint").alias("n_phantom_clicks"),
        hits.alias("valid_clicked_skus"),
        "file_row_idx",
    )


def product_dimension(staged: DataFrame, raw_catalog: DataFrame) -> DataFrame:
    """Every SKU browsed or in the catalog, with explicit unknown members."""
    browsed = staged.filter(F.col("product_sku_hash").isNotNull()).select("product_sku_hash").distinct()
    every = browsed.union(raw_catalog.select("product_sku_hash")).distinct()
    catalog = raw_catalog.drop("category_path").withColumn("__listed", F.lit(True))
    unknown = F.lit(c.UNKNOWN)
    return every.join(catalog, "product_sku_hash", "left").select(
        "product_sku_hash",
        F.coalesce("__listed", F.lit(False)).alias("in_catalog"),
        F.coalesce("category_lvl1", unknown).alias("category_lvl1"),
        F.coalesce("category_lvl2", unknown).alias("category_lvl2"),
        F.coalesce("category_lvl3", unknown).alias("category_lvl3"),
        "category_hash",
        F.coalesce("category_depth", F.lit(0).cast("bigint")).alias("category_depth"),
        "price_bucket",
        F.col("price_bucket").isNotNull().alias("has_price"),
        c.price_tier().alias("price_tier"),
    )
