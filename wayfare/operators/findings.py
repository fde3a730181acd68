"""Measured findings of the reports: one row per finding, from one-row aggregates.

`value` is the measure, `against` what it is read against (another rate or a count), both as double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators import funnel, product, search
from wayfare.operators.cells import cells_of, total
from wayfare.operators.tables import one_row, stacked

Rule = tuple[str, str, Column, Column, str]


def as_findings(row: DataFrame, rules: list[Rule]) -> DataFrame:
    records = [
        (F.lit(severity), F.lit(key), value.cast("double"), against.cast("double"), F.lit(text))
        for severity, key, value, against, text in rules
    ]
    return stacked(row, ["severity", "finding", "value", "against", "text"], records)


def funnel_findings(sessions: DataFrame) -> DataFrame:
    """The third finding appears only if both its rates are known and not zero."""
    cells = cells_of(sessions)
    carts = cells.agg(
        total("reached_add").alias("with_cart"),
        total("cart_abandoned").alias("abandoned"),
        total("purchase_without_add").alias("cross_session"),
    )
    row = one_row(funnel.headline(cells), carts, funnel.search_influence(cells))
    abandoned = c.percent(F.col("abandoned"), F.col("with_cart"))
    rules = [
        ("note", "conversion", F.col("conversion_pct"), F.col("strict_conversion_pct"),
         "percent of sessions that purchase; against the strict order of stages"),
        ("handle", "abandonment", abandoned, F.col("cross_session"),
         "percent of carts abandoned, an upper bound; against purchases without an add in their session"),
        ("note", "zero_result_conversion", F.col("conv_zero_result"), F.col("conv_search"),
         "conversion of sessions with an empty search; against all that search"),
    ]
    rows = as_findings(row, rules)
    return rows.filter((F.col("finding") != "zero_result_conversion") | ((F.col("value") > 0) & (F.col("against") > 0)))


def search_findings(searches: DataFrame, staged: DataFrame, sessions: DataFrame) -> DataFrame:
    clicks = search.click_positions(searches)
    row = one_row(
        searches.agg(
            F.count(F.lit(1)).alias("queries"),
            F.count_if("is_zero_result").alias("empty"),
            F.count_if(~F.col("is_zero_result")).alias("with_results"),
            F.count_if(F.array_size("valid_clicked_skus") > 0).alias("with_click"),
        ),
        clicks.agg(
            F.sum("clicks").alias("clicks"),
            F.sum(F.when(F.col("position") == 1, F.col("clicks")).otherwise(0)).alias("first_clicks"),
        ),
        search.click_outcome(searches, staged).select("clicked_pairs", "purchased_pct"),
        search.zero_result_impact(sessions).select("conv_zero", "conv_clean"),
    )
    rules = [
        ("note", "zero_results", c.percent(F.col("empty"), F.col("queries")), F.col("empty"),
         "percent of searches that return nothing; against their number"),
        ("note", "click_through", c.percent(F.col("with_click"), F.col("with_results")), F.col("with_results"),
         "percent clicked; against the searches that return something"),
        ("blocker", "first_position", c.percent(F.col("first_clicks"), F.col("clicks")), F.col("clicks"),
         "percent of clicks on the first result; against all clicks"),
        ("handle", "clicked_then_bought", F.col("purchased_pct"), F.col("clicked_pairs"),
         "percent of clicked products bought in the same session; against the clicked pairs"),
        ("note", "zero_result_conversion", F.col("conv_zero"), F.col("conv_clean"),
         "conversion of sessions with an empty search; against those without one"),
    ]
    return as_findings(row, rules)


def product_findings(products: DataFrame) -> DataFrame:
    viewed, known = F.col("sessions_viewed") > 0, F.col("category_lvl1") != c.UNKNOWN
    row = one_row(
        products.agg(
            F.count_if(viewed & known).alias("viewed_known"),
            F.count_if(viewed & ~known).alias("viewed_unknown"),
        ),
        product.coverage_by_traffic(products).select("price_purchases_pct", "all_purchases"),
        product.price_extremes(products).select("low_rate", "high_rate"),
        product.demand_concentration(products).select("top_10_pct"),
    )
    rules = [
        ("blocker", "metadata_of_viewed", F.col("viewed_known"), F.col("viewed_unknown"),
         "viewed SKUs with a category; against viewed SKUs without one"),
        ("handle", "purchases_without_price", F.lit(100.0) - F.col("price_purchases_pct"), F.col("all_purchases"),
         "percent of purchases on SKUs without a price bucket; against all purchases"),
        ("handle", "price_and_category", F.col("low_rate"), F.col("high_rate"),
         "purchases per view in the three cheapest buckets; against the three dearest, categories mixed"),
        ("note", "head_of_demand", F.col("top_10_pct"), F.lit(10.0),
         "percent of views on the most viewed SKUs; against their percent of all SKUs"),
    ]
    return as_findings(row, rules)
