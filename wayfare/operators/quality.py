"""Data quality of the raw tables, row reconciliation, constraints and parity of two copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.ordered import dealt, hot_keys, keys_named, previous_sliced, quantiles, split_hot
from wayfare.operators.staging import INSTANT, SESSION, TS, dedup_events, usable_events
from wayfare.operators.tables import one_row, stacked

NO_ACTION = "(none — pageview)"  # fixed value: label of events without an action
SESSION_GAP_MS = 30 * 60 * 1000  # fixed value: the documented session rule


def _count() -> Column:
    return F.count(F.lit(1))


def _long(value: int | None) -> Column:
    return F.lit(value).cast("bigint")


def volume(profile: DataFrame, browsing: DataFrame, search: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows, sessions and SKUs per raw table. Each distinct count is its own narrow plan."""
    row = one_row(
        profile.agg(_total("n").alias("b_rows"), F.count(SESSION).alias("b_sessions")),
        browsing.agg(F.count_distinct("product_sku_hash").alias("b_skus")),
        search.agg(_count().alias("s_rows"), F.count_distinct(SESSION).alias("s_sessions")),
        catalog.agg(_count().alias("c_rows"), F.count_distinct("product_sku_hash").alias("c_skus")),
    )
    return stacked(
        row,
        ["table_name", "n_rows", "n_sessions", "n_skus"],
        [
            (F.lit("raw_browsing"), F.col("b_rows"), F.col("b_sessions"), F.col("b_skus")),
            (F.lit("raw_search"), F.col("s_rows"), F.col("s_sessions"), _long(None)),
            (F.lit("raw_catalog"), F.col("c_rows"), _long(None), F.col("c_skus")),
        ],
    )


def completeness(browsing: DataFrame) -> DataFrame:
    """NULLs per column in one pass."""
    row = browsing.agg(
        _count().alias("n"), *[(_count() - F.count(k)).alias(k) for k in c.EVENT_COLUMNS]
    )
    return stacked(
        row,
        ["column_name", "null_rows", "null_pct"],
        [(F.lit(k), F.col(k), c.percent(F.col(k), F.col("n"))) for k in c.EVENT_COLUMNS],
    )


def event_taxonomy(browsing: DataFrame) -> DataFrame:
    """Events and sessions per (event type, action). Counted per session first, so a type that holds
    most rows is spread over its sessions."""
    action = F.coalesce("product_action", F.lit(NO_ACTION))
    per_session = browsing.groupBy("event_type", action.alias("product_action"), SESSION).agg(
        _count().alias("events")
    )
    return per_session.groupBy("event_type", "product_action").agg(
        F.sum("events").alias("events"), F.count(SESSION).alias("sessions")
    )


def _action_without_sku() -> Column:
    return F.count_if(F.col("product_action").isNotNull() & F.col("product_sku_hash").isNull())


def consistency(browsing: DataFrame) -> DataFrame:
    """Actions without a SKU, and SKUs without an action."""
    reverse = F.col("product_action").isNull() & F.col("product_sku_hash").isNotNull()
    row = browsing.agg(
        _count().alias("events"),
        _action_without_sku().alias("action_without_sku"),
        F.count_if(reverse).alias("sku_without_action"),
    )
    return row.select(
        "*",
        c.percent(F.col("action_without_sku"), F.col("events")).alias("action_without_sku_pct"),
        c.percent(F.col("sku_without_action"), F.col("events")).alias("sku_without_action_pct"),
    )


def _with_neighbours(events: DataFrame) -> DataFrame:
    by_session = Window.partitionBy(SESSION)
    return events.withColumns(
        {
            "in_file": F.lag(TS).over(by_session.orderBy("file_row_idx")),
            "in_time": F.lag(TS).over(by_session.orderBy(TS, "file_row_idx")),
        }
    )


def _with_neighbours_sliced(events: DataFrame, slices: int | None) -> DataFrame:
    place, key = F.col("file_row_idx"), [SESSION]
    in_file = previous_sliced(events, key, [place], TS, "in_file", slices)
    return previous_sliced(in_file, key, [F.col(TS), place], TS, "in_time", slices)


def _profile(events: DataFrame) -> DataFrame:
    """Events -> distinct events -> instants (session, time, URL) -> moments (session, time) -> sessions.

    Each step groups by a subset of the columns of the step before. On rows that lie together by session
    none of them shuffles; otherwise each merges its groups before it does.
    """

    def carried(*names: str) -> list[Column]:
        return [F.sum(n).alias(n) for n in names] + [F.max("gap").alias("gap")]

    distinct = events.groupBy(*c.EVENT_COLUMNS).agg(
        _count().alias("n"),
        F.count_if(F.col(TS) < F.col("in_file")).alias("back"),
        F.max(F.col(TS) - F.col("in_time")).alias("gap"),
    )
    action, n = F.col("product_action"), F.col("n")
    kinds = {"details": "detail", "adds": "add", "removes": "remove", "purchases": "purchase"}
    counted = {name: action == value for name, value in kinds.items()}
    counted["pageviews"] = F.col("event_type") == "pageview"
    measured = distinct.withColumns(
        {
            **{name: F.when(is_kind, n).otherwise(0) for name, is_kind in counted.items()},
            "duplicate_groups": (n > 1).cast("bigint"),
            "redundant_copies": n - 1,
        }
    )
    sums = ["n", "back", *counted, "duplicate_groups", "redundant_copies"]
    instants = measured.groupBy(*INSTANT).agg(*carried(*sums))
    both = F.col("hashed_url").isNotNull() & (F.col("details") > 0) & (F.col("pageviews") > 0)
    sums.append("pdp_pairs")
    moments = instants.withColumn("pdp_pairs", both.cast("bigint")).groupBy(SESSION, TS).agg(*carried(*sums))
    return moments.groupBy(SESSION).agg(
        *carried(*sums),
        F.count_if(F.col("n") > 1).alias("collisions"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
    )


def session_profile(
    browsing: DataFrame,
    hot_rows: int | None = None,
    slices: int | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """One row per raw session with all that the checks below count; one shuffle of the events.

    Columns: events `n`, steps `back` in time along the file, largest `gap` in time, events per kind,
    repeated rows and their copies, moments with several events, detail/pageview pairs, first and last time.
    """
    events = browsing.select(*c.EVENT_COLUMNS, "file_row_idx")
    found = hot_keys(events, [SESSION], hot_rows) if heavy is None else keys_named(heavy, "session")
    hot, ordinary = split_hot(events, [SESSION], found)
    profile = _profile(_with_neighbours(dealt(ordinary, [SESSION])))
    if hot is None:
        return profile
    return profile.unionByName(_profile(_with_neighbours_sliced(hot, slices)))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), _long(0))


def _known_session() -> Column:
    return F.col(SESSION).isNotNull()


def _bad_sessions() -> Column:
    return F.count_if((F.col("back") > 0) & _known_session())


def _violating_sessions() -> Column:
    return F.count_if((F.col("gap") > SESSION_GAP_MS) & _known_session())


def span(profile: DataFrame) -> DataFrame:
    """First and last instant, whole days between."""
    ends = profile.agg(F.min("first_ts").alias("first_ms"), F.max("last_ts").alias("last_ms"))
    return ends.select(
        "first_ms",
        "last_ms",
        c.event_time("first_ms").alias("first_time"),
        c.event_time("last_ms").alias("last_time"),
        F.expr(f"(last_ms - first_ms) div {c.DAY_MS}L").alias("days"),
    )


def duplicates(profile: DataFrame) -> DataFrame:
    """Distinct repeated rows and their redundant copies, NULL keys included.

    Compared on the columns themselves: a 64-bit hash could merge two rows once there are billions.
    """
    return profile.agg(*[_total(n).alias(n) for n in ("duplicate_groups", "redundant_copies")])


def order_inversions(profile: DataFrame) -> DataFrame:
    """Events that lie before their predecessor in file order, and the sessions that hold one."""
    row = profile.agg(
        _total("back").alias("inversions"),
        _bad_sessions().alias("bad_sessions"),
        F.count(SESSION).alias("all_sessions"),
        _total("n").alias("events"),
    )
    return row.select(
        "*",
        c.percent(F.col("inversions"), F.col("events")).alias("inversion_pct"),
        c.percent(F.col("bad_sessions"), F.col("all_sessions")).alias("bad_session_pct"),
    )


def timestamp_collisions(profile: DataFrame) -> DataFrame:
    """(session, millisecond) pairs with two or more events, the pairs explained by the product-page
    double fire, and the rest."""
    row = profile.agg(_total("collisions").alias("collisions"), _total("pdp_pairs").alias("pdp_pairs"))
    return row.select(
        "collisions",
        "pdp_pairs",
        (F.col("collisions") - F.col("pdp_pairs")).alias("residual"),
        c.percent(F.col("pdp_pairs"), F.col("collisions")).alias("pdp_pct"),
    )


def pdp_pairs(profile: DataFrame) -> DataFrame:
    """Instants (session, millisecond, known URL) with both a detail and a pageview."""
    return profile.agg(_total("pdp_pairs").alias("pdp_pairs"))


def session_gaps(profile: DataFrame) -> DataFrame:
    """Sessions with an inner gap above the session rule, and the largest gap."""
    row = profile.agg(
        _violating_sessions().alias("violating_sessions"),
        F.max("gap").alias("max_gap_ms"),
        F.count(SESSION).alias("all_sessions"),
    )
    return row.select(
        "*",
        c.percent(F.col("violating_sessions"), F.col("all_sessions")).alias("violating_pct"),
        (F.coalesce("max_gap_ms", _long(0)).cast("double") / F.lit(3_600_000.0)).alias("max_gap_hours"),
    )


def session_duration_stats(profile: DataFrame, slices: int | None = None) -> DataFrame:
    """Exact median and 95th percentile, and the longest session, from raw events."""
    lengths = profile.select((F.col("last_ts") - F.col("first_ts")).alias("ms"))
    marks = quantiles(lengths, "ms", {"median_ms": 0.5, "p95_ms": 0.95, "max_ms": 1.0}, slices=slices)
    return marks.select(
        (F.col("median_ms") / 1000.0).alias("median_sec"),
        (F.col("p95_ms") / 1000.0).alias("p95_sec"),
        (F.col("max_ms") / 3_600_000.0).alias("max_hours"),
    )


def orphan_skus(browsing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Browsed SKUs without a catalog row. Both sides are distinct before they meet."""
    browsed = browsing.filter(F.col("product_sku_hash").isNotNull()).select("product_sku_hash").distinct()
    listed = catalog.select("product_sku_hash").distinct().withColumn("__listed", F.lit(True))
    row = browsed.join(listed, "product_sku_hash", "left").agg(
        _count().alias("browsed_skus"), F.count_if(F.col("__listed").isNull()).alias("orphan_skus")
    )
    return row.select("*", c.percent(F.col("orphan_skus"), F.col("browsed_skus")).alias("orphan_pct"))


def catalog_missing(catalog: DataFrame) -> DataFrame:
    no_category, no_price = F.col("category_hash").isNull(), F.col("price_bucket").isNull()
    row = catalog.agg(
        _count().alias("catalog_rows"),
        F.count_if(no_category).alias("no_category"),
        F.count_if(no_price).alias("no_price"),
        F.count_if(no_category & no_price).alias("no_either"),
        F.count_distinct("category_hash").alias("category_paths"),
    )
    return row.select(
        "*",
        *[
            c.percent(F.col(k), F.col("catalog_rows")).alias(f"{k}_pct")
            for k in ("no_category", "no_price", "no_either")
        ],
    )


def category_depth(catalog: DataFrame) -> DataFrame:
    known = catalog.filter(F.col("category_hash").isNotNull())
    return known.groupBy("category_depth").agg(_count().alias("skus"))


def funnel_integrity(profile: DataFrame) -> DataFrame:
    """Sessions whose raw events break the assumed order of the funnel."""
    details, adds, removes, purchases, pageviews = (
        F.col(n) for n in ("details", "adds", "removes", "purchases", "pageviews")
    )
    row = profile.agg(
        _count().alias("sessions"),
        F.count_if(purchases > 0).alias("with_purchase"),
        F.count_if((purchases > 0) & (adds == 0)).alias("purchase_no_add"),
        F.count_if((adds > 0) & (details == 0)).alias("add_no_detail"),
        F.count_if((purchases > 0) & (pageviews == 0)).alias("purchase_no_pageview"),
        F.count_if((removes > 0) & (adds == 0)).alias("remove_no_add"),
    )
    return row.select(
        "*",
        c.percent(F.col("purchase_no_add"), F.col("with_purchase")).alias("purchase_no_add_pct"),
        c.percent(F.col("purchase_no_pageview"), F.col("with_purchase")).alias("purchase_no_pageview_pct"),
    )


def search_lists(search: DataFrame) -> DataFrame:
    """Missing and empty result lists, queries with a click."""
    row = search.agg(
        _count().alias("queries"),
        F.count_if(F.col("product_skus").isNull()).alias("null_results"),
        F.count_if(F.array_size("product_skus") == 0).alias("empty_results"),
        F.count_if(F.array_size("clicked_skus") > 0).alias("with_click"),
        F.count_distinct(SESSION).alias("sessions"),
    )
    return row.select(
        "*",
        *[
            c.percent(F.col(k), F.col("queries")).alias(f"{k}_pct")
            for k in ("null_results", "empty_results", "with_click")
        ],
    )


def _phantom_click() -> Column:
    shown = F.coalesce("product_skus", F.array().cast("array<string>"))
    return F.exists("clicked_skus", lambda sku: ~F.array_contains(shown, sku))


def search_phantom(search: DataFrame) -> DataFrame:
    """Queries with a click outside the result list. Counts queries; staging counts the clicks."""
    return search.agg(
        F.count_if(_phantom_click()).alias("phantom_queries"),
        c.percent(F.count_if(_phantom_click()), _count()).alias("phantom_pct"),
    )


def search_sizes(search: DataFrame) -> DataFrame:
    """Result list sizes. A list size is a small whole number, so Spark's exact percentile keeps one
    counter per size however many queries there are."""
    sizes = search.filter(F.array_size("product_skus") > 0).select(F.array_size("product_skus").alias("n"))
    return sizes.agg(
        F.percentile("n", F.lit(0.5)).alias("median_size"),
        F.percentile("n", F.lit(0.95)).alias("p95_size"),
        F.max(F.col("n").cast("bigint")).alias("max_size"),
    )


def search_orphans(profile: DataFrame, search: DataFrame) -> DataFrame:
    """Search sessions that never browse; one row per session on both sides."""
    searching = search.select(SESSION).distinct()
    return searching.join(profile.select(SESSION), SESSION, "left_anti").agg(_count().alias("orphan_sessions"))


def reconcile(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """raw - unusable - copies - paired pageviews = staged, one row per term.

    Built from groupings only, independent of the windows that staging uses.
    """
    usable = F.col(SESSION).isNotNull() & F.col(TS).isNotNull()
    # One chain: distinct rows, then instants that carry copies and pairs, then totals.
    instants = dedup_events(usable_events(raw)).groupBy(*INSTANT).agg(
        F.sum(F.col("raw_row_count") - 1).alias("copies"),
        F.count_if(F.col("event_type") == "pageview").alias("pageviews"),
        F.count_if(F.col("product_action") == "detail").alias("details"),
    )
    paired = F.when(F.col("hashed_url").isNotNull() & (F.col("details") > 0), F.col("pageviews")).otherwise(_long(0))
    row = one_row(
        raw.agg(_count().alias("raw"), F.count_if(~usable).alias("unusable")),
        instants.agg(
            F.coalesce(F.sum("copies"), _long(0)).alias("copies"), F.coalesce(F.sum(paired), _long(0)).alias("paired")
        ),
        staged.agg(_count().alias("staged")),
    )
    expected = F.col("raw") - F.col("unusable") - F.col("copies") - F.col("paired")
    return stacked(
        row,
        ["step", "term", "n_rows"],
        [
            (_long(1), F.lit("raw_browsing"), F.col("raw")),
            (_long(2), F.lit("unusable: no session or time"), -F.col("unusable")),
            (_long(3), F.lit("redundant copies"), -F.col("copies")),
            (_long(4), F.lit("pageviews paired with a detail"), -F.col("paired")),
            (_long(5), F.lit("expected stg_browsing"), expected),
            (_long(6), F.lit("actual stg_browsing"), F.col("staged")),
            (_long(7), F.lit("unexplained"), F.col("staged") - expected),
        ],
    )


def findings(
    profile: DataFrame, browsing: DataFrame, search: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Severity and measured rate of each finding; a finding appears only if its count is not zero.

    Most measures come from the session profile; the events are read once more for rows and once for SKUs.
    """
    nothing = F.col("product_skus").isNull() | (F.array_size("product_skus") == 0)
    row = one_row(
        browsing.agg(_count().alias("events"), _action_without_sku().alias("action_without_sku")),
        profile.agg(
            _total("redundant_copies").alias("redundant_copies"),
            _bad_sessions().alias("bad_sessions"),
            _violating_sessions().alias("violating_sessions"),
            F.count(SESSION).alias("all_sessions"),
            _total("collisions").alias("collisions"),
            _total("pdp_pairs").alias("pdp_pairs"),
        ),
        span(profile).select("days"),
        funnel_integrity(profile).select("with_purchase", "purchase_no_add", "remove_no_add"),
        orphan_skus(browsing, catalog).select("browsed_skus", "orphan_skus"),
        catalog_missing(catalog).select("catalog_rows", "no_price"),
        search.agg(
            _count().alias("queries"),
            F.count_if(nothing).alias("nothing_found"),
            F.count_if(_phantom_click()).alias("phantom_queries"),
        ),
        search_orphans(profile, search).select("orphan_sessions"),
    )
    rules = [
        ("note", "days", None, "days observed"),
        ("handle", "action_without_sku", "events", "product events without a SKU"),
        ("handle", "redundant_copies", "events", "redundant copies of events"),
        ("note", "bad_sessions", "all_sessions", "sessions out of order in the file"),
        ("blocker", "collisions", None, "session instants with several events"),
        ("handle", "pdp_pairs", "collisions", "detail and pageview double fires"),
        ("handle", "violating_sessions", "all_sessions", "sessions that break the gap rule"),
        ("handle", "orphan_skus", "browsed_skus", "browsed SKUs missing from the catalog"),
        ("handle", "no_price", "catalog_rows", "catalog SKUs without a price bucket"),
        ("blocker", "purchase_no_add", "with_purchase", "purchasing sessions without an add"),
        ("note", "remove_no_add", None, "sessions that remove without an add"),
        ("note", "nothing_found", "queries", "searches that returned nothing"),
        ("handle", "phantom_queries", "queries", "searches with a click outside the results"),
        ("note", "orphan_sessions", None, "search sessions that never browse"),
    ]
    rows = stacked(
        row,
        ["severity", "finding", "value", "pct", "text"],
        [
            (
                F.lit(severity),
                F.lit(key),
                F.col(key),
                c.percent(F.col(key), F.col(whole)) if whole else F.lit(None).cast("double"),
                F.concat(F.col(key).cast("string"), F.lit(f" {text}")),
            )
            for severity, key, whole, text in rules
        ],
    )
    return rows.filter(F.col("value") > 0)


NOT_NULL_SESSION = [
    "session_id_hash", "session_start", "session_end", "day_of_week", "hour_of_day", "n_events",
    "n_pageviews", "n_product_views", "n_adds", "n_removes", "n_purchases", "n_skus_viewed",
    "n_skus_added", "n_skus_purchased", "n_unique_pages", "reached_session", "reached_detail",
    "reached_add", "reached_purchase", "purchase_without_add", "is_bounce", "cart_abandoned",
    "cart_emptied", "n_searches", "n_zero_result_searches", "n_search_clicks",
    "n_valid_search_clicks", "n_search_impressions", "used_search", "had_duplicate_events",
]
NOT_NULL_DIMENSION = [
    "product_sku_hash", "in_catalog", "category_lvl1", "category_lvl2", "category_lvl3",
    "category_depth", "has_price", "price_tier",
]
NOT_NULL_PRODUCT = [
    "product_sku_hash", "sessions_viewed", "sessions_added", "sessions_purchased",
    "sessions_removed", "n_views", "n_adds", "n_purchases",
]


def _any_null(names: list[str]) -> Column:
    return F.greatest(*[F.col(n).isNull() for n in names])


def _repeated(df: DataFrame, key: str, name: str) -> DataFrame:
    copies = df.groupBy(key).agg(_count().alias("n"))
    return copies.agg(F.count_if(F.col("n") > 1).alias(name))


def constraint_violations(sessions: DataFrame, products: DataFrame, dimension: DataFrame) -> DataFrame:
    """Violations per rule of the serving schema; every count must be zero."""
    strict = F.col("strict_purchase")
    broken = F.coalesce(strict, F.lit(False)) & ~F.col("reached_purchase")
    orphans = products.select("product_sku_hash").join(
        dimension.select("product_sku_hash"), "product_sku_hash", "left_anti"
    )
    row = one_row(
        sessions.agg(
            F.count_if(broken).alias("strict_implies_attained"),
            F.count_if(F.col("cart_abandoned") & ~F.col("reached_add")).alias("abandoned_implies_add"),
            F.count_if(_any_null(NOT_NULL_SESSION)).alias("fct_session_not_null"),
        ),
        dimension.agg(F.count_if(_any_null(NOT_NULL_DIMENSION)).alias("dim_product_not_null")),
        products.agg(F.count_if(_any_null(NOT_NULL_PRODUCT)).alias("fct_product_performance_not_null")),
        _repeated(sessions, SESSION, "fct_session_unique"),
        _repeated(dimension, "product_sku_hash", "dim_product_unique"),
        _repeated(products, "product_sku_hash", "fct_product_performance_unique"),
        orphans.agg(_count().alias("product_in_dimension")),
    )
    return stacked(row, ["rule", "violations"], [(F.lit(n), F.col(n)) for n in row.columns])


def _text(value: Column) -> Column:
    """Numbers compare after rounding to 2 places, so the order of a float sum does not matter."""
    return F.round(value.cast("double"), 2).cast("string")


def _sums(names: list[str]) -> dict[str, Column]:
    return {f"sum_{n}": _text(F.sum(n)) for n in names}


def _flags(names: list[str]) -> dict[str, Column]:
    return {n: _text(F.count_if(n)) for n in names}


def parity_measures() -> dict[str, dict[str, Column]]:
    """Table -> measure -> aggregate, each as text: the 19 values two copies of the marts must share."""
    start = F.col("session_start")
    return {
        "dim_product": {
            "rows": _text(_count()),
            "not_in_catalog": _text(F.count_if(~F.col("in_catalog"))),
            "unknown_price_tier": _text(F.count_if(F.col("price_tier") == c.UNKNOWN)),
        },
        "fct_product_performance": {"rows": _text(_count()), **_sums(["sessions_viewed"])},
        "fct_session": {
            "rows": _text(_count()),
            **_flags(["reached_detail", "reached_add", "reached_purchase", "strict_purchase"]),
            **_flags(["cart_abandoned", "purchase_without_add"]),
            **_sums(["n_events", "n_search_clicks", "n_search_impressions", "n_zero_result_searches"]),
            "mean_duration_sec_capped": _text(F.avg("duration_sec_capped")),
            "first_session_start": F.min(start).cast("string"),
            "last_session_start": F.max(start).cast("string"),
        },
    }


def parity_values(tables) -> DataFrame:
    """(label, value) rows for the three marts in `tables`."""
    parts = []
    for table, measures in parity_measures().items():
        row = tables[table].agg(*[value.alias(name) for name, value in measures.items()])
        records = [(F.lit(f"{table}.{name}"), F.col(name)) for name in measures]
        parts.append(stacked(row, ["label", "value"], records))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compare two `parity_values` tables label by label."""
    a = left.withColumnRenamed("value", "left_value")
    b = right.withColumnRenamed("value", "right_value")
    return a.join(b, "label", "full").withColumn("matches", F.col("left_value").eqNullSafe(F.col("right_value")))
