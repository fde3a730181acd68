"""Funnel analysis: aggregates with their percentages over the session summary (`cells`), no driver-side work.

Every report takes the cells, or the session fact, whose cells it then makes for itself. The medians of all reports
come from one chain of passes over the sessions, `session_medians`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators.cells import FLAGS, cells_of, depth_band, total
from wayfare.operators.marts import entry_context
from wayfare.operators.selection import quantiles_by_group
from wayfare.operators.staging import SESSION
from wayfare.operators.tables import one_row, stacked

# The names of the days.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _stage_counts(sessions: DataFrame) -> DataFrame:
    return cells_of(sessions).agg(
        total().alias("n"), *[total(f).alias(f) for f in FLAGS if f.startswith(("reached", "strict"))], total("is_bounce").alias("bounces")
    )


def session_medians(sessions: DataFrame) -> DataFrame:
    """(measure, median) of all session reports: cart size, duration by depth band, times to each milestone.

    Each session gives one row per measure it has; all medians are selected together.
    """
    buy, add = F.col("reached_purchase"), F.col("reached_add")
    measures = [
        (F.lit("cart:n_skus_added"), F.when(add, F.col("n_skus_added"))),
        (F.concat(F.lit("depth:"), depth_band()), F.col("duration_sec_capped")),
        (F.lit("timing:first_add"), F.when(add, F.col("sec_to_first_add"))),
        (F.lit("timing:purchase"), F.when(buy, F.col("sec_to_purchase"))),
        (F.lit("timing:add_to_purchase"), F.when(buy & add, F.col("sec_add_to_purchase"))),
        (F.lit("timing:duration_all"), F.col("duration_sec_capped")),
        (F.lit("timing:duration_converting"), F.when(buy, F.col("duration_sec_capped"))),
    ]
    rows = F.array(*[F.struct(name.alias("measure"), value.cast("double").alias("value")) for name, value in measures])
    long = sessions.select(F.inline(rows)).filter(F.col("value").isNotNull())
    return quantiles_by_group(long, "measure", "value", {"median": 0.5})


def _medians(medians: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    mine = medians.filter(F.startswith(F.col("measure"), F.lit(f"{kind}:")))
    return mine.select(F.substring_index("measure", ":", -1).alias(key), F.col("median").alias(name))


def overview(sessions: DataFrame) -> DataFrame:
    """Four stages under both definitions, sessions only one definition counts, step conversion."""
    n = F.col("n")
    stages = [
        ("Session started", n, n, None),
        ("Product detail view", F.col("reached_detail"), F.col("strict_detail"), n),
        ("Add to cart", F.col("reached_add"), F.col("strict_add"), F.col("reached_detail")),
        ("Purchase", F.col("reached_purchase"), F.col("strict_purchase"), F.col("reached_add")),
    ]
    return stacked(
        _stage_counts(sessions),
        ["step", "stage", "attained", "attained_pct", "strict", "strict_pct", "hidden", "step_pct"],
        [
            (
                F.lit(i).cast("bigint"),
                F.lit(name),
                attained,
                c.percent(attained, n),
                strict,
                c.percent(strict, n),
                attained - strict,
                F.lit(None).cast("double") if before is None else c.percent(attained, before),
            )
            for i, (name, attained, strict, before) in enumerate(stages, 1)
        ],
    )


def headline(sessions: DataFrame) -> DataFrame:
    """Overall conversion, hidden conversions and bounces."""
    n, hidden = F.col("n"), F.col("reached_purchase") - F.col("strict_purchase")
    return _stage_counts(sessions).select(
        n.alias("sessions"),
        c.percent(F.col("reached_purchase"), n).alias("conversion_pct"),
        c.percent(F.col("strict_purchase"), n).alias("strict_conversion_pct"),
        hidden.alias("hidden_conversions"),
        c.percent(hidden, F.col("reached_purchase")).alias("hidden_pct"),
        "bounces",
        c.percent(F.col("bounces"), n).alias("bounce_pct"),
    )


def abandonment(sessions: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    medians = session_medians(sessions) if medians is None else medians
    row = one_row(
        cells_of(sessions).agg(
            total("reached_add").alias("with_cart"),
            total("cart_abandoned").alias("abandoned"),
            total("cart_emptied").alias("emptied"),
            total("purchase_without_add").alias("cross_session"),
        ),
        _medians(medians, "cart", "__of", "median_skus_added").select("median_skus_added"),
    )
    return row.select(
        "*",
        c.percent(F.col("abandoned"), F.col("with_cart")).alias("abandoned_pct"),
        c.percent(F.col("emptied"), F.col("with_cart")).alias("emptied_pct"),
    )


def by_cart_size(sessions: DataFrame) -> DataFrame:
    """Conversion by distinct SKUs added."""
    carts = cells_of(sessions).filter("cart_size is not null").groupBy("cart_size").agg(
        F.min("fewest_skus").alias("smallest"),
        total().alias("carts"),
        total("reached_purchase").alias("converted"),
        c.rate(total("reached_purchase"), total()).alias("conv_rate"),
    )
    return carts.orderBy("smallest")


def session_depth(sessions: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Conversion and median capped duration by events per session. Six groups at most."""
    medians = session_medians(sessions) if medians is None else medians
    rates = cells_of(sessions).groupBy("depth_band").agg(
        F.min("fewest_events").alias("fewest_events"),
        total().alias("sessions"),
        c.rate(total("reached_purchase"), total()).alias("conv_rate"),
    )
    marks = _medians(medians, "depth", "depth_band", "median_duration_sec")
    return rates.join(marks, "depth_band", "left").orderBy("fewest_events")


def timing_medians(sessions: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Five exact medians; a milestone that no session has is left out."""
    medians = session_medians(sessions) if medians is None else medians
    return _medians(medians, "timing", "milestone", "median_sec")


def search_influence(sessions: DataFrame) -> DataFrame:
    searched, zero = F.col("used_search"), F.col("had_zero_result")

    def converted(segment: Column) -> Column:
        return c.rate(total("reached_purchase", segment), total(where=segment))

    row = cells_of(sessions).agg(
        total(where=searched).alias("searched"),
        total(where=~searched).alias("not_searched"),
        converted(searched).alias("conv_search"),
        converted(~searched).alias("conv_no_search"),
        total(where=zero).alias("had_zero_result"),
        converted(zero).alias("conv_zero_result"),
    )
    times = F.col("conv_search") / F.nullif(F.col("conv_no_search"), F.lit(0.0))
    return row.select("*", F.coalesce(times, F.lit(0.0)).alias("search_lift"))


def _pattern(sessions: DataFrame, column: str) -> DataFrame:
    return cells_of(sessions).groupBy(column).agg(
        total().alias("sessions"), c.rate(total("reached_purchase"), total()).alias("conv_rate")
    )


def by_weekday(sessions: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    day = F.get(names, F.col("day_of_week").cast("int"))
    return _pattern(sessions, "day_of_week").withColumn("day_name", day).orderBy("day_of_week")


def by_hour(sessions: DataFrame) -> DataFrame:
    return _pattern(sessions, "hour_of_day").orderBy("hour_of_day")


def by_entry_hour(sessions: DataFrame, staged: DataFrame) -> DataFrame:
    """Sessions and conversion by the hour of the first event; `moved` counts those that the smallest hour puts elsewhere."""
    entered = sessions.select(SESSION, "hour_of_day", "reached_purchase").join(entry_context(staged), SESSION)
    n = F.count(F.lit(1))
    return entered.groupBy("entry_hour").agg(
        n.alias("sessions"),
        c.rate(F.count_if("reached_purchase"), n).alias("conv_rate"),
        F.count_if(F.col("entry_hour") != F.col("hour_of_day")).alias("moved"),
    )


def hourly_extremes(sessions: DataFrame) -> DataFrame:
    """Busiest, quietest and best-converting hour; ties go to the earliest hour."""
    hour, n, rate = F.col("hour_of_day"), F.col("sessions"), F.col("conv_rate")
    row = _pattern(sessions, "hour_of_day").agg(
        F.max_by(F.struct(hour, n, rate), F.struct(n, -hour)).alias("busiest"),
        F.min_by(F.struct(hour, n, rate), F.struct(n, hour)).alias("quietest"),
        F.max_by(F.struct(hour, n, rate), F.struct(rate, -hour)).alias("best"),
    )
    shares = c.ratio(F.col("busiest.sessions"), F.col("quietest.sessions"))
    return stacked(
        row,
        ["kind", "hour_of_day", "sessions", "conv_rate", "peak_to_trough"],
        [
            (
                F.lit(kind),
                F.col(f"{kind}.hour_of_day"),
                F.col(f"{kind}.sessions"),
                F.col(f"{kind}.conv_rate"),
                shares,
            )
            for kind in ("busiest", "quietest", "best")
        ],
    )


def funnel_view(sessions: DataFrame) -> DataFrame:
    """The serving view: (stage, definition) rows, share rounded to four places."""
    n = F.col("n")
    records = []
    for kind, name in (("reached", "step_attained"), ("strict", "strict_sequence")):
        stages = [("Session", n)] + [
            (label, F.col(f"{kind}_{stage}"))
            for label, stage in (("Product detail", "detail"), ("Add to cart", "add"), ("Purchase", "purchase"))
        ]
        records += [
            (
                F.lit(label),
                F.lit(i).cast("bigint"),
                F.lit(name),
                count,
                F.round(c.rate(count, n), 4),
            )
            for i, (label, count) in enumerate(stages, 1)
        ]
    view = stacked(
        _stage_counts(sessions), ["stage", "step_order", "definition", "sessions", "pct_of_sessions"], records
    )
    return view.orderBy("definition", "step_order")
