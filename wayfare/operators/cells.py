"""The session summary: counts of sessions per cell, written once, from which the counting reports are answered.

A cell is a weekday, an hour, a depth band, a cart size and two search flags: some ten thousand cells at most,
whatever the number of sessions. One grouping with map-side combine makes them; every report adds up cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import columns as c

# Upper bounds and labels of the report bands.
CART_BANDS = [(1, "1 item"), (2, "2 items"), (5, "3-5 items")]
DEPTH_BANDS = [(1, "1 (bounce)"), (4, "2-4"), (9, "5-9"), (24, "10-24"), (49, "25-49")]

FLAGS = [
    *(f"{kind}_{stage}" for kind in ("reached", "strict") for stage in ("detail", "add", "purchase")),
    "is_bounce",
    "cart_abandoned",
    "cart_emptied",
    "purchase_without_add",
]
SESSIONS = "n_sessions"


def depth_band() -> Column:
    return c.banded(F.col("n_events"), DEPTH_BANDS, "50+")


def cart_size() -> Column:
    """Distinct SKUs added, in bands; a cart of adds without a SKU falls into the last band, no cart is NULL."""
    size = F.col("n_skus_added")
    return F.when(F.col("reached_add"), F.when(size >= 1, c.banded(size, CART_BANDS, "6+ items")).otherwise("6+ items"))


def session_cells(sessions: DataFrame) -> DataFrame:
    """One row per cell: n_sessions, one count per flag, least numbers of events and of SKUs added."""
    return sessions.groupBy(
        "day_of_week",
        "hour_of_day",
        depth_band().alias("depth_band"),
        cart_size().alias("cart_size"),
        F.col("used_search").alias("used_search"),
        (F.col("n_zero_result_searches") > 0).alias("had_zero_result"),
    ).agg(
        F.count(F.lit(1)).alias(SESSIONS),
        *[F.count_if(flag).alias(flag) for flag in FLAGS],
        F.min("n_events").alias("fewest_events"),
        F.min("n_skus_added").alias("fewest_skus"),
    )


def cells_of(table: DataFrame) -> DataFrame:
    """The cells of a session table; a table of cells is taken as it is."""
    return table if SESSIONS in table.columns else session_cells(table)


def total(name: str = SESSIONS, where: Column | None = None) -> Column:
    """A count over cells, zero over none."""
    counted = F.col(name) if where is None else F.when(where, F.col(name))
    return F.coalesce(F.sum(counted), F.lit(0).cast("bigint"))
