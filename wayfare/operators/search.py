"""Search analysis: volume, position of clicks, what a click leads to, the cost of empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.marts import in_stage
from wayfare.operators.ordered import quantiles
from wayfare.operators.staging import SESSION
from wayfare.operators.tables import one_row

# Upper bounds and labels of the position bands; positions shown on the curve.
POSITION_BANDS = [(1, "1 (first result)"), (2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (20, "11-20")]
CURVE_POSITIONS = 20


def _count() -> Column:
    return F.count(F.lit(1))


def _clicked() -> Column:
    return F.array_size("valid_clicked_skus") > 0


def volume(searches: DataFrame) -> DataFrame:
    """Query counts; the click-through rate is over queries that returned something."""
    shown = ~F.col("is_zero_result")
    row = one_row(
        searches.agg(
            _count().alias("queries"),
            F.count_distinct(SESSION).alias("sessions"),
            F.count_if("is_zero_result").alias("zero_result"),
            F.count_if(shown).alias("with_results"),
            F.count_if(_clicked()).alias("with_click"),
            F.sum("n_phantom_clicks").alias("phantom_clicks"),
        ),
        quantiles(searches.filter(shown), "n_results", {"median_results": 0.5}),
    )
    return row.select(
        "*",
        c.percent(F.col("zero_result"), F.col("queries")).alias("zero_result_pct"),
        c.percent(F.col("with_results"), F.col("queries")).alias("with_results_pct"),
        c.percent(F.col("with_click"), F.col("queries")).alias("with_click_pct"),
        c.percent(F.col("with_click"), F.col("with_results")).alias("click_through_pct"),
    )


def click_positions(searches: DataFrame) -> DataFrame:
    """Clicks per first position (1-based) of the clicked SKU: one row per position.

    Counted before anything else, so later steps see one row per list position.
    """
    ranks = F.transform("valid_clicked_skus", lambda sku: F.array_position("result_skus", sku))
    return (
        searches.filter(_clicked())
        .select(F.explode(ranks).alias("position"))
        .filter(F.col("position") > 0)
        .groupBy(F.col("position").cast("bigint").alias("position"))
        .agg(_count().alias("clicks"))
    )


def position_bias(searches: DataFrame) -> DataFrame:
    """Clicks per position band, best position first."""
    band = c.banded(F.col("position"), POSITION_BANDS, "21+")
    bands = click_positions(searches).groupBy(band.alias("position_band")).agg(
        F.min("position").alias("first_position"), F.sum("clicks").alias("clicks")
    )
    # Seven bands at most.
    total = F.sum("clicks").over(Window.partitionBy(F.lit(0)))
    return bands.withColumn("pct", c.percent(F.col("clicks"), total)).orderBy("first_position")


def position_curve(searches: DataFrame, last: int | None = CURVE_POSITIONS) -> DataFrame:
    """Share and cumulative share of all valid clicks by position, up to `last`; None gives the full curve."""
    # One row per list position: both windows see at most as many rows as the longest list has places.
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = click_positions(searches).select(
        "position",
        "clicks",
        c.percent(F.col("clicks"), F.sum("clicks").over(every)).alias("share_pct"),
        c.percent(F.sum("clicks").over(upto), F.sum("clicks").over(every)).alias("cumulative_pct"),
    )
    shown = shares if last is None else shares.filter(F.col("position") <= last)
    return shown.orderBy("position")


def click_rank_stats(searches: DataFrame) -> DataFrame:
    """Median and 90th percentile of the clicked position, exact, from the counts per position."""
    positions = click_positions(searches)
    return positions.agg(
        F.percentile("position", F.lit(0.5), F.col("clicks")).alias("median_position"),
        F.percentile("position", F.lit(0.9), F.col("clicks")).alias("p90_position"),
        F.sum("clicks").alias("clicks"),
    )


def click_outcome(searches: DataFrame, staged: DataFrame) -> DataFrame:
    """Distinct clicked (session, SKU) pairs that were viewed, added, bought in the same session.

    Both sides have one row per pair before they meet, so neither a hot session nor a hot SKU can
    multiply or pile up rows.
    """
    pair = [SESSION, "product_sku_hash"]
    clicked = (
        searches.filter(_clicked())
        .select(SESSION, F.explode("valid_clicked_skus").alias("product_sku_hash"))
        .distinct()
    )
    stages = in_stage("product_detail") | in_stage("add_to_cart") | in_stage("purchase")
    seen = (
        staged.filter(F.col("product_sku_hash").isNotNull() & F.col("first_of_stage_sku") & stages)
        .groupBy(*pair)
        .agg(
            F.max(in_stage("product_detail")).alias("viewed"),
            F.max(in_stage("add_to_cart")).alias("added"),
            F.max(in_stage("purchase")).alias("purchased"),
        )
    )
    row = clicked.join(seen, pair, "left").agg(
        _count().alias("clicked_pairs"),
        *[F.count_if(k).alias(k) for k in ("viewed", "added", "purchased")],
    )
    return row.select(
        "*",
        *[c.percent(F.col(k), F.col("clicked_pairs")).alias(f"{k}_pct") for k in ("viewed", "added", "purchased")],
    )


def zero_result_impact(sessions: DataFrame) -> DataFrame:
    """Conversion of searching sessions with and without an empty result, and the gap."""
    searched, zero = F.col("used_search"), F.col("n_zero_result_searches") > 0

    def converted(segment: Column) -> Column:
        return c.rate(F.count_if(segment & F.col("reached_purchase")), F.count_if(segment))

    row = sessions.agg(
        F.count_if(searched).alias("searched"),
        F.count_if(zero).alias("any_zero"),
        (F.count_if(searched) - F.count_if(zero)).alias("no_zero"),
        converted(searched).alias("conv_search"),
        converted(zero).alias("conv_zero"),
        converted(searched & (F.col("n_zero_result_searches") == 0)).alias("conv_clean"),
    )
    nothing = F.lit(0.0)
    return row.select("*", (F.coalesce("conv_zero", nothing) - F.coalesce("conv_clean", nothing)).alias("gap_pp"))
