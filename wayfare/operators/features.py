"""Cart features that stop at the first add-to-cart, and the label after it.

Each event of a cart session carries the sequence number, time and SKU of the session's first add
(`cart_*`, from staging), so the truncation is a filter inside one aggregation: no join back to the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.marts import in_stage, valid_clicks
from wayfare.operators.ordered import FIND, hot_keys, join_unique, sent, split_hot
from wayfare.operators.staging import SESSION, TS


def cart_events(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("cart_seq").isNotNull())


def first_add(staged: DataFrame) -> DataFrame:
    """The prediction point of each cart session; exactly one event per session passes."""
    return staged.filter(F.col("event_seq") == F.col("cart_seq")).select(
        SESSION,
        F.col("event_seq").alias("add_seq"),
        F.col(TS).alias("add_ts"),
        F.col("product_sku_hash").alias("added_sku"),
    )


def _before() -> Column:
    return F.col("event_seq") <= F.col("cart_seq")


def _after() -> Column:
    return F.col("event_seq") > F.col("cart_seq")


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("bigint")


def by_cart(staged: DataFrame) -> GroupedData:
    """Events of cart sessions by session. The anchor is a function of the session and rides in the
    key: as an aggregate, its text SKU would turn the hash aggregation into a sort."""
    return cart_events(staged).groupBy(
        SESSION,
        F.col("cart_seq").alias("add_seq"),
        F.col("cart_ts").alias("add_ts"),
        F.col("cart_sku").alias("added_sku"),
    )


def truncated_columns() -> list[Column]:
    before, detail = _before(), in_stage("product_detail")
    same_sku = F.col("product_sku_hash") == F.col("cart_sku")
    return [
        F.count_if(before).alias("pre_n_events"),
        F.count_if(before & in_stage("pageview")).alias("pre_n_pageviews"),
        F.count_if(before & detail).alias("pre_n_product_views"),
        F.count_if(before & in_stage("remove_from_cart")).alias("pre_n_removes"),
        # The first occurrence lies in the prefix exactly when the value does.
        F.count_if(before & detail & F.col("first_of_stage_sku")).alias("pre_n_skus_viewed"),
        F.count_if(before & F.col("first_of_url")).alias("pre_n_unique_pages"),
        _flag(before & detail & same_sku).alias("pre_viewed_added_sku"),
        (F.min("cart_ts") - F.min(F.when(before, F.col(TS)))).alias("pre_ms_to_add"),
    ]


def label_columns() -> list[Column]:
    bought = _after() & in_stage("purchase")
    return [
        _flag(bought).alias("purchased"),
        _flag(bought & (F.col("product_sku_hash") == F.col("cart_sku"))).alias("purchased_added_sku"),
    ]


def truncated_features(staged: DataFrame) -> DataFrame:
    return by_cart(staged).agg(*truncated_columns())


def cart_label(staged: DataFrame) -> DataFrame:
    return cart_events(staged).groupBy(SESSION).agg(*label_columns())


def _early_searches(anchors: DataFrame, events: DataFrame) -> DataFrame:
    """Searches up to the session's add, without a join: both kinds of rows meet on one exchange by session, and
    the add's time runs over the rows of its session."""
    none = F.lit(None)
    asked = {"add_ts": none.cast("bigint")}
    point = {TS: none.cast("bigint"), "is_zero_result": none.cast("boolean"), "__clicks": none.cast("bigint")}
    together = anchors.withColumns(point).unionByName(events.withColumns(asked))
    add = F.max("add_ts").over(Window.partitionBy(SESSION))
    return together.withColumn("__add", add).filter(F.col(TS) <= F.col("__add"))


def pre_search_features(
    anchors: DataFrame,
    searches: DataFrame,
    hot_rows: int | None = None,
    hot: DataFrame | object | None = FIND,
    bucketed: bool = False,
) -> DataFrame:
    """Searches up to the add, per cart session that has any.

    `anchors` has one row per session (`first_add`). Sessions with very many searches are left where they lie: the one
    add of each is sent to them, and their searches are summed before they move. `hot` names them if they are known.
    Inputs that lie in equal buckets (`bucketed`) are joined where they are: a union would give their places up.
    """
    events = searches.select(SESSION, TS, "is_zero_result", valid_clicks().alias("__clicks"))
    if hot is FIND:
        hot = hot_keys(events, [SESSION], hot_rows)
    many, few = split_hot(events, [SESSION], hot)
    _, ordinary = split_hot(anchors.select(SESSION, "add_ts"), [SESSION], hot)
    if bucketed:
        early = few.join(ordinary, SESSION).filter(F.col(TS) <= F.col("add_ts"))
    else:
        early = _early_searches(ordinary, few)
    sums = [
        F.count(F.lit(1)).alias("pre_n_searches"),
        F.count_if("is_zero_result").alias("pre_n_zero_result"),
        F.sum("__clicks").alias("pre_n_search_clicks"),
    ]
    counted = early.groupBy(SESSION).agg(*sums)
    if many is None:
        return counted
    point, _ = split_hot(anchors.select(SESSION, "add_ts"), [SESSION], hot)
    late = many.join(sent(point, hot), SESSION).filter(F.col(TS) <= F.col("add_ts"))
    return counted.unionByName(late.groupBy(SESSION).agg(*sums))


CART_COLUMNS = [
    SESSION,
    "add_time",
    "add_ts",
    "pre_n_events",
    "pre_n_pageviews",
    "pre_n_product_views",
    "pre_n_removes",
    "pre_n_skus_viewed",
    "pre_n_unique_pages",
    "pre_viewed_added_sku",
    "pre_add_position",
    "pre_sec_to_add",
    "pre_events_per_min",
    "pre_skus_per_page",
    "pre_n_searches",
    "pre_n_zero_result",
    "pre_n_search_clicks",
    "pre_used_search",
    "day_of_week",
    "hour_of_day",
    "is_weekend",
    "price_bucket",
    "price_is_unknown",
    "category_lvl1",
    "category_depth",
    "purchased",
    "purchased_added_sku",
]


def cart_sessions(
    staged: DataFrame,
    searches: DataFrame,
    dimension: DataFrame,
    hot_rows: int | None = None,
    hot: DataFrame | object | None = FIND,
    bucketed: bool = False,
) -> DataFrame:
    """The feature table: one row per session with an add, features before it, label after it.

    `hot` names sessions with very many searches if they are known; `bucketed`: both inputs lie in equal buckets.
    """
    anchors = first_add(staged)
    carts = by_cart(staged).agg(*truncated_columns(), *label_columns())
    searched = carts.join(pre_search_features(anchors, searches, hot_rows, hot, bucketed), SESSION, "left")
    product = dimension.select(
        F.col("product_sku_hash").alias("added_sku"), "price_bucket", "category_lvl1", "category_depth"
    )
    popular = hot_keys(anchors, ["added_sku"], hot_rows)
    described = join_unique(searched, product, ["added_sku"], "left", popular)
    zero = F.lit(0).cast("bigint")
    minutes = F.col("pre_ms_to_add").cast("double") / F.lit(60000.0)
    searches_before = F.coalesce("pre_n_searches", zero)
    return described.withColumns(
        {
            "add_time": c.event_time("add_ts"),
            "pre_add_position": F.col("add_seq"),
            "pre_sec_to_add": c.seconds(F.col("pre_ms_to_add")),
            "pre_events_per_min": F.when(
                F.col("pre_ms_to_add") > 0, F.col("pre_n_events").cast("double") / minutes
            ),
            "pre_skus_per_page": c.ratio(F.col("pre_n_skus_viewed"), F.col("pre_n_unique_pages")),
            "pre_n_searches": searches_before,
            "pre_n_zero_result": F.coalesce("pre_n_zero_result", zero),
            "pre_n_search_clicks": F.coalesce("pre_n_search_clicks", zero),
            "pre_used_search": (searches_before > 0).cast("bigint"),
            "day_of_week": c.day_of_week("add_ts"),
            "hour_of_day": c.hour_of_day("add_ts"),
            "is_weekend": c.day_of_week("add_ts").isin(0, 6).cast("bigint"),
            "price_is_unknown": F.col("price_bucket").isNull().cast("bigint"),
            "category_lvl1": F.coalesce("category_lvl1", F.lit(c.UNKNOWN)),
            "category_depth": F.coalesce("category_depth", zero),
        }
    ).select(*CART_COLUMNS)
