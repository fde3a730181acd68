"""Product analysis: catalog coverage, categories, price, concentration of demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.ordered import number_sliced, quantiles, running_totals
from wayfare.operators.tables import one_row

CONCENTRATION = {"top_1_pct": 1, "top_10_pct": 10, "top_20_pct": 20}  # fixed values: percent of SKUs
LETTERS = 26  # categories beyond this rank are numbered
LORENZ_HEAD, LORENZ_STEP = 50, 200  # fixed values: curve points kept


def _count() -> Column:
    return F.count(F.lit(1))


def _known(column: str) -> Column:
    return F.col(column) != c.UNKNOWN


def coverage(dimension: DataFrame, products: DataFrame) -> DataFrame:
    """Of the SKUs with browsing activity: in the catalog, with a category, with a price."""
    active = dimension.join(products.select("product_sku_hash"), "product_sku_hash", "left_semi")
    row = active.agg(
        _count().alias("skus_seen"),
        F.count_if("in_catalog").alias("in_catalog"),
        F.count_if(_known("category_lvl1")).alias("with_category"),
        F.count_if("has_price").alias("with_price"),
    )
    return row.select(
        "*",
        *[
            c.percent(F.col(k), F.col("skus_seen")).alias(f"{k}_pct")
            for k in ("in_catalog", "with_category", "with_price")
        ],
    )


def coverage_by_traffic(products: DataFrame) -> DataFrame:
    """The same coverage weighted by views and purchases."""

    def covered(count: str, by: str) -> Column:
        return F.sum(F.when(_known(by), F.col(count)))

    row = products.agg(
        F.sum("sessions_viewed").alias("all_views"),
        covered("sessions_viewed", "category_lvl1").alias("category_views"),
        covered("sessions_viewed", "price_tier").alias("price_views"),
        F.sum("sessions_purchased").alias("all_purchases"),
        covered("sessions_purchased", "price_tier").alias("price_purchases"),
    )
    return row.select(
        "*",
        c.percent(F.col("category_views"), F.col("all_views")).alias("category_views_pct"),
        c.percent(F.col("price_views"), F.col("all_views")).alias("price_views_pct"),
        c.percent(F.col("price_purchases"), F.col("all_purchases")).alias("price_purchases_pct"),
    )


def missingness(products: DataFrame) -> DataFrame:
    """SKUs by (has a category, was ever viewed)."""
    return products.groupBy(
        _known("category_lvl1").alias("has_category"), (F.col("sessions_viewed") > 0).alias("was_viewed")
    ).agg(_count().alias("skus"))


def behaviour_by_view(products: DataFrame) -> DataFrame:
    group = F.when(F.col("sessions_viewed") == 0, "Never viewed").otherwise("Viewed")
    return products.groupBy(group.alias("grp")).agg(
        _count().alias("skus"),
        F.sum("sessions_added").alias("adds"),
        F.sum("sessions_purchased").alias("purchases"),
        F.sum("sessions_removed").alias("removes"),
    )


def _totals(products: DataFrame, by: str) -> DataFrame:
    """Views are distinct sessions per SKU, summed; rates may exceed 100."""
    grouped = products.groupBy(by).agg(
        _count().alias("skus"),
        F.sum("sessions_viewed").alias("views"),
        F.sum("sessions_added").alias("adds"),
        F.sum("sessions_purchased").alias("purchases"),
    )
    return grouped.withColumns(
        {
            "view_to_add_pct": c.percent(F.col("adds"), F.col("views")),
            "view_to_purchase_pct": c.percent(F.col("purchases"), F.col("views")),
        }
    )


def pseudonym(rank: Column) -> Column:
    """Category A..Z by rank, then a number."""
    letter = F.char(F.lit(ord("A")) + rank - 1)
    return F.when(rank <= LETTERS, F.concat(F.lit("Category "), letter)).otherwise(
        F.concat(F.lit("Category #"), rank.cast("string"))
    )


def category_performance(products: DataFrame, slices: int | None = None) -> DataFrame:
    """Categories under pseudonyms by falling traffic, ties by name. The name itself is not shown."""
    named = products.filter(_known("category_lvl1"))
    order = [F.col("views").desc(), F.col("category_lvl1")]
    ranked = number_sliced(_totals(named, "category_lvl1"), [], order, "category_rank", slices)
    return (
        ranked.withColumn("category", pseudonym(F.col("category_rank")))
        .drop("category_lvl1")
        .orderBy("category_rank")
    )


def price_sensitivity(products: DataFrame) -> DataFrame:
    return _totals(products.filter(F.col("price_bucket").isNotNull()), "price_bucket").orderBy("price_bucket")


def price_extremes(products: DataFrame) -> DataFrame:
    """View-to-purchase rate of the three cheapest against the three dearest deciles."""

    def summed(count: str, band: Column) -> Column:
        return F.sum(F.when(band, F.col(count)))

    low, high = F.col("price_bucket") <= 3, F.col("price_bucket") >= 8
    zero = F.lit(0).cast("bigint")
    row = products.agg(
        *[
            F.coalesce(summed(count, band), zero).alias(f"{name}_{label}")
            for name, band in (("low", low), ("high", high))
            for count, label in (("sessions_viewed", "views"), ("sessions_purchased", "purchases"))
        ]
    )
    return row.select(
        "*",
        c.percent(F.col("low_purchases"), F.col("low_views")).alias("low_rate"),
        c.percent(F.col("high_purchases"), F.col("high_views")).alias("high_rate"),
    )


def assortment_shape(products: DataFrame) -> DataFrame:
    viewed, added = F.col("sessions_viewed"), F.col("sessions_added")
    row = one_row(
        products.agg(
            _count().alias("skus"),
            F.count_if(viewed == 0).alias("never_viewed"),
            F.count_if((viewed > 0) & (added == 0)).alias("viewed_never_added"),
            F.count_if(F.col("sessions_purchased") > 0).alias("ever_purchased"),
        ),
        quantiles(products, "sessions_viewed", {"median_views": 0.5}),
    )
    return row.select(
        "*",
        c.percent(F.col("viewed_never_added"), F.col("skus")).alias("viewed_never_added_pct"),
        c.percent(F.col("ever_purchased"), F.col("skus")).alias("ever_purchased_pct"),
    )


def demand_concentration(products: DataFrame, slices: int | None = None) -> DataFrame:
    """Share of all views taken by the top 1, 10 and 20 % of SKUs.

    SKUs with equal views are counted together first; inside such a block the running sum is linear, so
    the sum at the wanted rank follows from the block alone and no SKU-level sort is needed.
    """
    blocks = products.groupBy(F.col("sessions_viewed").alias("views")).agg(_count().alias("n"))
    blocks = blocks.withColumn("mass", F.col("views") * F.col("n"))
    run = running_totals(blocks, [], [F.col("views").desc()], {"n": "skus_to", "mass": "views_to"}, slices)
    views = F.col("views_to_total")
    before = F.col("skus_to") - F.col("n")
    shares = []
    for name, part in CONCENTRATION.items():
        rank = F.expr(f"skus_to_total * {part} div 100")  # whole numbers: no rounding at the border
        inside = (before < rank) & (rank <= F.col("skus_to"))
        upto = F.col("views_to") - F.col("mass") + (rank - before) * F.col("views")
        shares.append(F.max(F.when(inside, c.rate(upto, views))).alias(name))
    return run.agg(*shares)


def lorenz_curve(products: DataFrame, slices: int | None = None, step: int | None = LORENZ_STEP) -> DataFrame:
    """Cumulative share of views over SKUs by falling views: the first 50 points and each `step`th; None gives all."""
    marked = products.select("product_sku_hash", "sessions_viewed", F.lit(1).cast("bigint").alias("one"))
    order = [F.col("sessions_viewed").desc(), F.col("product_sku_hash")]
    run = running_totals(marked, [], order, {"one": "rn", "sessions_viewed": "cume"}, slices)
    kept = run if step is None else run.filter((F.col("rn") <= LORENZ_HEAD) | (F.col("rn") % step == 0))
    return kept.select(
        "rn",
        c.rate(F.col("rn"), F.col("rn_total")).alias("pct_skus"),
        c.rate(F.col("cume"), F.col("cume_total")).alias("pct_views"),
    ).orderBy("rn")


def category_view(products: DataFrame, dimension: DataFrame) -> DataFrame:
    """The serving view per category; price statistics carry their coverage."""
    priced = dimension.select("product_sku_hash", F.col("category_lvl1"), "has_price", "price_bucket")
    joined = products.select(
        "product_sku_hash", "sessions_viewed", "sessions_added", "sessions_purchased"
    ).join(priced, "product_sku_hash", "inner")
    has = F.col("has_price")
    return (
        joined.groupBy("category_lvl1")
        .agg(
            _count().alias("skus"),
            F.sum("sessions_viewed").alias("sessions_viewed"),
            F.sum("sessions_added").alias("sessions_added"),
            F.sum("sessions_purchased").alias("sessions_purchased"),
            F.round(c.rate(F.count_if(has), _count()), 2).alias("pct_with_price"),
            F.round(F.avg(F.when(has, F.col("price_bucket"))), 2).alias("avg_price_bucket"),
            F.round(c.rate(F.sum("sessions_purchased"), F.sum("sessions_viewed")), 4).alias(
                "view_to_purchase_pct"
            ),
        )
        .orderBy(F.desc("sessions_viewed"), "category_lvl1")
    )
