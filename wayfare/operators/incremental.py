"""Marts brought up to date from new rows: only the sessions that new rows touch are computed again.

New events and searches name the touched sessions. Their old raw events, found by a semi join, are staged together with
the new ones; their rows in the session tables are replaced, all others stay as they are. The product counts are sums,
so they take what the touched sessions count now less what they counted before; SKUs without any event left go.
The result equals a full build over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import features, marts, staging
from wayfare.operators.staging import SESSION
from wayfare.session import written

SKU = "product_sku_hash"
# What a build leaves behind for the next update, besides the raw rows.
KEPT = ["stg_browsing", "stg_search", "product_counts", "dim_product", "fct_session", "fct_product_performance", "ml_cart_sessions"]


@dataclass
class Change:
    """What new rows touch: the sessions, and the staged events and searches of those, before and after."""

    sessions: DataFrame
    before: DataFrame
    after: DataFrame
    searches: DataFrame
    new_searches: DataFrame


def touched_sessions(new_browsing: DataFrame, new_search: DataFrame) -> DataFrame:
    """Sessions with a usable new event or search, one row each."""
    rows = [staging.usable_events(x).select(SESSION) for x in (new_browsing, new_search)]
    return reduce(DataFrame.unionAll, rows).distinct()


def of_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """Touched sessions are a share of all sessions, so they never go through the driver to all executors."""
    return table.join(sessions.hint("merge"), SESSION, "left_semi")


def upsert(table: DataFrame, fresh: DataFrame, sessions: DataFrame) -> DataFrame:
    """`table` with the rows of `sessions` replaced by `fresh`."""
    return table.join(sessions.hint("merge"), SESSION, "left_anti").unionByName(fresh)


def change(
    kept: dict[str, DataFrame],
    old_browsing: DataFrame,
    new_browsing: DataFrame,
    new_search: DataFrame,
    hot_rows: int | None = None,
    slices: int | None = None,
) -> Change:
    """The change set of new raw rows. Old raw rows are read and joined once: staging reads its input several times, so
    the rows of touched sessions are written before it.
    """
    sessions = written(touched_sessions(new_browsing, new_search), "touched")
    columns = new_browsing.columns
    raw = of_sessions(old_browsing, sessions).select(*columns).unionByName(new_browsing.select(*columns))
    raw = written(raw, "touched-raw")
    after = written(staging.stage_browsing(raw, hot_rows, slices), "touched-events")
    new_searches = written(staging.stage_search(new_search), "new-searches")
    searches = of_sessions(kept["stg_search"], sessions).unionByName(new_searches)
    return Change(sessions, of_sessions(kept["stg_browsing"], sessions), after, searches, new_searches)


def updated_counts(counts: DataFrame, change: Change) -> DataFrame:
    """Product counts after the change: sums of the old counts and of the difference; touched SKUs only are added up."""
    names = [n for n in counts.columns if n != SKU]
    less = marts.product_counts(change.before).select(SKU, *[(-F.col(n)).alias(n) for n in names])
    difference = less.unionByName(marts.product_counts(change.after)).unionByName(counts)
    return difference.groupBy(SKU).agg(*[F.sum(n).alias(n) for n in names]).filter("n_events > 0")


def updated_dimension(dimension: DataFrame, counts: DataFrame, raw_catalog: DataFrame) -> DataFrame:
    """The dimension with SKUs seen for the first time, without SKUs that neither events nor the catalog hold."""
    browsed = counts.select(SKU)
    new = browsed.join(dimension, SKU, "left_anti")
    known = dimension.join(browsed, SKU, "left_semi").unionByName(dimension.filter("in_catalog").join(browsed, SKU, "left_anti"))
    nothing = raw_catalog.filter(F.lit(False))
    return known.unionByName(staging.product_dimension(new, nothing))


def update(
    kept: dict[str, DataFrame],
    old_browsing: DataFrame,
    new_browsing: DataFrame,
    new_search: DataFrame,
    raw_catalog: DataFrame,
    hot_rows: int | None = None,
    slices: int | None = None,
) -> dict[str, DataFrame]:
    """The tables of `KEPT` after new raw rows, from their state before.

    The catalog is the one of the build before. New rows carry file positions of their own, as the log gives them.
    """
    moved = change(kept, old_browsing, new_browsing, new_search, hot_rows, slices)
    counts = written(updated_counts(kept["product_counts"], moved), "product-counts")
    dimension = written(updated_dimension(kept["dim_product"], counts, raw_catalog), "dimension")
    fact = marts.session_fact(moved.after, moved.searches)
    carts = features.cart_sessions(moved.after, moved.searches, dimension, hot_rows)
    return {
        "stg_browsing": upsert(kept["stg_browsing"], moved.after, moved.sessions),
        "stg_search": kept["stg_search"].unionByName(moved.new_searches),
        "product_counts": counts,
        "dim_product": dimension,
        "fct_session": upsert(kept["fct_session"], fact, moved.sessions),
        "fct_product_performance": marts.product_rates(counts, dimension),
        "ml_cart_sessions": upsert(kept["ml_cart_sessions"], carts, moved.sessions),
    }
