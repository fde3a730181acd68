"""Session and product marts: one partial aggregation and one narrow shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.staging import SESSION, TS

CAP_SECONDS = 1800.0  # fixed value: the reported duration stops at 30 minutes


def in_stage(name: str) -> Column:
    return F.col("funnel_stage") == name


def session_rollup(staged: DataFrame) -> DataFrame:
    """Per session: counts per stage, distinct SKUs and pages, first arrivals.

    Distinct counts are sums of the first-occurrence flags of staging, so a session of any size is
    merged before the shuffle.
    """
    detail, add = in_stage("product_detail"), in_stage("add_to_cart")
    remove, purchase = in_stage("remove_from_cart"), in_stage("purchase")
    new_sku = F.col("first_of_stage_sku")
    return staged.groupBy(SESSION).agg(
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.min("event_ts").alias("session_start"),
        F.max("event_ts").alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(in_stage("pageview")).alias("n_pageviews"),
        F.count_if(detail).alias("n_product_views"),
        F.count_if(add).alias("n_adds"),
        F.count_if(remove).alias("n_removes"),
        F.count_if(purchase).alias("n_purchases"),
        F.count_if(detail & new_sku).alias("n_skus_viewed"),
        F.count_if(add & new_sku).alias("n_skus_added"),
        F.count_if(purchase & new_sku).alias("n_skus_purchased"),
        F.count_if(F.col("first_of_url")).alias("n_unique_pages"),
        F.min(F.when(detail, F.col("event_seq"))).alias("first_detail_seq"),
        F.min(F.when(add, F.col("event_seq"))).alias("first_add_seq"),
        F.min(F.when(purchase, F.col("event_seq"))).alias("first_purchase_seq"),
        F.min(F.when(add, F.col(TS))).alias("first_add_ts"),
        F.min(F.when(purchase, F.col(TS))).alias("first_purchase_ts"),
        # Smallest value in the session, not the value at entry.
        F.min("day_of_week").alias("day_of_week"),
        F.min("hour_of_day").alias("hour_of_day"),
        (F.max("raw_row_count") > 1).alias("had_duplicate_events"),
    )


def entry_context(staged: DataFrame) -> DataFrame:
    """Weekday and hour of each session's first event: a filter, no shuffle."""
    first = staged.filter(F.col("event_seq") == 1)
    return first.select(SESSION, F.col("day_of_week").alias("entry_day"), F.col("hour_of_day").alias("entry_hour"))


def valid_clicks() -> Column:
    """Clicks inside the result list, from the two counts: the lists themselves stay unread."""
    return F.col("n_clicks") - F.col("n_phantom_clicks")


def session_search_rollup(searches: DataFrame) -> DataFrame:
    return searches.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("n_searches"),
        F.count_if("is_zero_result").alias("n_zero_result_searches"),
        F.sum("n_clicks").alias("n_search_clicks"),
        F.sum(valid_clicks()).alias("n_valid_search_clicks"),
        F.sum("n_results").alias("n_search_impressions"),
    )


def duration_columns() -> dict[str, Column]:
    raw = c.seconds(F.col("last_ts") - F.col("first_ts"))
    return {"duration_sec_raw": raw, "duration_sec_capped": F.least(raw, F.lit(CAP_SECONDS))}


def attained_columns() -> dict[str, Column]:
    """Did the session ever reach the stage, in any order?"""
    return {
        "reached_session": F.lit(True),
        "reached_detail": F.col("n_product_views") > 0,
        "reached_add": F.col("n_adds") > 0,
        "reached_purchase": F.col("n_purchases") > 0,
    }


def strict_columns() -> dict[str, Column]:
    """First detail before first add before first purchase; NULL when a later step never came."""
    seen = F.col("first_detail_seq").isNotNull()
    added = seen & (F.col("first_add_seq") > F.col("first_detail_seq"))
    bought = added & (F.col("first_purchase_seq") > F.col("first_add_seq"))
    return {"strict_detail": seen, "strict_add": added, "strict_purchase": bought}


def outcome_columns() -> dict[str, Column]:
    adds, removes, buys = F.col("n_adds"), F.col("n_removes"), F.col("n_purchases")
    return {
        "purchase_without_add": (buys > 0) & (adds == 0),
        "is_bounce": F.col("n_events") == 1,
        "cart_abandoned": (adds > 0) & (buys == 0),
        "cart_emptied": (adds > 0) & (removes >= adds) & (buys == 0),
    }


def timing_columns() -> dict[str, Column]:
    start, add, buy = F.col("first_ts"), F.col("first_add_ts"), F.col("first_purchase_ts")
    return {
        "sec_to_first_add": c.seconds(add - start),
        "sec_to_purchase": c.seconds(buy - start),
        "sec_add_to_purchase": c.seconds(buy - add),
    }


SEARCH_COUNTS = [
    "n_searches",
    "n_zero_result_searches",
    "n_search_clicks",
    "n_valid_search_clicks",
    "n_search_impressions",
]

SESSION_COLUMNS = [
    SESSION,
    "session_start",
    "session_end",
    "day_of_week",
    "hour_of_day",
    "duration_sec_raw",
    "duration_sec_capped",
    "n_events",
    "n_pageviews",
    "n_product_views",
    "n_adds",
    "n_removes",
    "n_purchases",
    "n_skus_viewed",
    "n_skus_added",
    "n_skus_purchased",
    "n_unique_pages",
    "reached_session",
    "reached_detail",
    "reached_add",
    "reached_purchase",
    "strict_detail",
    "strict_add",
    "strict_purchase",
    "purchase_without_add",
    "is_bounce",
    "cart_abandoned",
    "cart_emptied",
    "sec_to_first_add",
    "sec_to_purchase",
    "sec_add_to_purchase",
    *SEARCH_COUNTS,
    "used_search",
    "had_duplicate_events",
]


def session_fact(staged: DataFrame, searches: DataFrame) -> DataFrame:
    """One row per browsing session. Both sides of the join have one row per session."""
    sessions = session_rollup(staged).join(session_search_rollup(searches), SESSION, "left")
    zero = F.lit(0).cast("bigint")
    counted = sessions.withColumns({n: F.coalesce(n, zero) for n in SEARCH_COUNTS})
    return counted.withColumns(
        {
            **duration_columns(),
            **attained_columns(),
            **strict_columns(),
            **outcome_columns(),
            **timing_columns(),
            "used_search": F.col("n_searches") > 0,
        }
    ).select(*SESSION_COLUMNS)


PRODUCT_COLUMNS = [
    "product_sku_hash",
    "sessions_viewed",
    "sessions_added",
    "sessions_purchased",
    "sessions_removed",
    "n_views",
    "n_adds",
    "n_purchases",
    "in_catalog",
    "category_lvl1",
    "category_lvl2",
    "price_bucket",
    "price_tier",
    "view_to_add_rate",
    "add_to_purchase_rate",
    "view_to_purchase_rate",
]


def product_counts(staged: DataFrame) -> DataFrame:
    """Per SKU: events and distinct sessions per stage. All are sums of flags, so counts of parts add up, and a hot
    SKU is merged before the shuffle."""
    detail, add = in_stage("product_detail"), in_stage("add_to_cart")
    remove, purchase = in_stage("remove_from_cart"), in_stage("purchase")
    new = F.col("first_of_stage_sku")
    return (
        staged.filter(F.col("product_sku_hash").isNotNull())
        .groupBy("product_sku_hash")
        .agg(
            F.count_if(detail & new).alias("sessions_viewed"),
            F.count_if(add & new).alias("sessions_added"),
            F.count_if(purchase & new).alias("sessions_purchased"),
            F.count_if(remove & new).alias("sessions_removed"),
            F.count_if(detail).alias("n_views"),
            F.count_if(add).alias("n_adds"),
            F.count_if(purchase).alias("n_purchases"),
            F.count(F.lit(1)).alias("n_events"),
        )
    )


def product_rates(counts: DataFrame, dimension: DataFrame) -> DataFrame:
    """The product mart from counts; a rate is undefined, not zero, when nobody viewed or added."""
    viewed, added, bought = (F.col(f"sessions_{n}") for n in ("viewed", "added", "purchased"))
    return (
        counts.join(dimension, "product_sku_hash", "left")
        .withColumns(
            {
                "view_to_add_rate": c.ratio(added, viewed),
                "add_to_purchase_rate": c.ratio(bought, added),
                "view_to_purchase_rate": c.ratio(bought, viewed),
            }
        )
        .select(*PRODUCT_COLUMNS)
    )


def product_performance(staged: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per SKU: counts, distinct sessions per stage, rates."""
    return product_rates(product_counts(staged), dimension)
