"""Reusable column expressions for clickstream rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# Fixed values of the data model.
UNKNOWN = "(unknown)"
EVENT_COLUMNS = [
    "session_id_hash",
    "event_type",
    "product_action",
    "product_sku_hash",
    "server_timestamp_epoch_ms",
    "hashed_url",
]
STAGE_OF_ACTION = {
    "purchase": "purchase",
    "add": "add_to_cart",
    "remove": "remove_from_cart",
    "detail": "product_detail",
}
NULL_MARK = "<N>"


def blank_to_null(column: Column | str) -> Column:
    """Empty and all-space strings become NULL; other strings lose their outer spaces."""
    trimmed = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.nullif(trimmed, F.lit(""))


def parse_list(column: Column | str) -> Column:
    """`['a', 'b']` -> array('a', 'b'). A blank literal is NULL and `[]` is the empty array."""
    text = blank_to_null(column)
    bare = F.translate(text, "[]' ", "")
    empty = F.array().cast("array<string>")
    return F.when(text.isNull(), None).when(bare == "", empty).otherwise(F.split(bare, ","))


def parse_vector(column: Column | str) -> Column:
    """`[0.1, -0.2]` -> array<double>; blank is NULL. A bad number raises under ANSI."""
    text = blank_to_null(column)
    bare = F.translate(text, "[] ", "")
    empty = F.array().cast("array<double>")
    return (
        F.when(text.isNull(), None)
        .when(bare == "", empty)
        .otherwise(F.split(bare, ",").cast("array<double>"))
    )


def format_list(column: Column | str) -> Column:
    """The inverse of `parse_list`: array -> `['a', 'b']`, NULL or empty -> NULL."""
    array = F.col(column) if isinstance(column, str) else column
    return F.when(F.array_size(array) > 0, F.concat(F.lit("['"), F.array_join(array, "', '"), F.lit("']")))


def hierarchy(column: Column | str) -> dict[str, Column]:
    """Split a `/` path into its array, three levels (NULL when absent) and its depth."""
    path = F.split(F.col(column) if isinstance(column, str) else column, "/")
    return {
        "category_path": path,
        "category_lvl1": F.get(path, F.lit(0)),
        "category_lvl2": F.get(path, F.lit(1)),
        "category_lvl3": F.get(path, F.lit(2)),
        "category_depth": F.when(path.isNotNull(), F.array_size(path)).cast("bigint"),
    }


def fingerprint(columns: list[str]) -> Column:
    """64-bit row hash. The mark keeps NULLs in place: the hash itself skips them."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns])


def event_time(ms: str) -> Column:
    """Epoch milliseconds as a zone-free timestamp, the same under every session time zone."""
    return F.expr(f"timestampadd(MILLISECOND, {ms}, timestamp_ntz'1970-01-01 00:00:00')")


def hour_of_day(ms: str) -> Column:
    """UTC hour by whole-number arithmetic on the epoch, so no zone can enter."""
    return F.expr(f"pmod({ms}, {DAY_MS}L) div {HOUR_MS}L")


def day_of_week(ms: str) -> Column:
    """UTC day of the week, Sunday = 0. 1970-01-01 was a Thursday (4)."""
    return F.expr(f"pmod(({ms} - pmod({ms}, {DAY_MS}L)) div {DAY_MS}L + 4, 7L)")


def funnel_stage(action: Column | str = "product_action") -> Column:
    source = F.col(action) if isinstance(action, str) else action
    stage = None
    for value, name in STAGE_OF_ACTION.items():
        stage = F.when(source == value, name) if stage is None else stage.when(source == value, name)
    return stage.otherwise("pageview")


def price_tier(bucket: Column | str = "price_bucket") -> Column:
    """Ordinal grouping of the price deciles 1-10."""
    value = F.col(bucket) if isinstance(bucket, str) else bucket
    return (
        F.when(value.isNull(), UNKNOWN)
        .when(value <= 3, "low (1-3)")
        .when(value <= 7, "mid (4-7)")
        .otherwise("high (8-10)")
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rate(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL when whole is zero."""
    return F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; zero when whole is zero, as the reports print it."""
    return F.coalesce(rate(part, whole), F.lit(0.0))


def seconds(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000.0)


def banded(value: Column, bands: list[tuple[int, str]], above: str) -> Column:
    """Label a count by upper bounds: [(1, "1"), (4, "2-4")] and a label for the rest."""
    label = None
    for upper, name in bands:
        label = F.when(value <= upper, name) if label is None else label.when(value <= upper, name)
    return label.otherwise(above)
