"""Event tables laid out so that scans skip what a filter rules out.

Rows are dealt to folders by day and sorted by session inside a day, in small row groups: a day filter opens one
folder, a session filter the row groups whose range holds the session. Columns that rows are not sorted by, such as
the SKU, get Bloom filters, which rule out row groups that hold none of the wanted values. A day or a session with a
third of all rows is cut into range parts by session and time like all others, so no task writes it alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.staging import SESSION, TS

DAY = "event_day"
ROW_GROUP_BYTES = 16 << 20
DISTINCT_VALUES = 100_000  # of a Bloom filter column in one row group, expected; more make it weaker, never wrong


def with_day(events: DataFrame) -> DataFrame:
    """The UTC day as a date, from whole milliseconds; NULL without a time."""
    days = F.floor(F.col(TS) / F.lit(86_400_000)).cast("int")
    return events.withColumn(DAY, F.date_add(F.lit("1970-01-01").cast("date"), days))


def write_clustered(
    events: DataFrame,
    path: str,
    bloom: tuple[str, ...] = (SESSION, "product_sku_hash"),
    row_group_bytes: int = ROW_GROUP_BYTES,
    parts: int | None = None,
    distinct_values: int = DISTINCT_VALUES,
) -> DataFrame:
    """Write events by day and session and return the table; an existing table at `path` raises."""
    dealt = with_day(events)
    number = [] if parts is None else [parts]
    order = [DAY, SESSION, TS]
    writer = dealt.repartitionByRange(*number, *order).sortWithinPartitions(*order).write.mode("errorifexists")
    writer = writer.partitionBy(DAY).option("parquet.block.size", row_group_bytes)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", distinct_values)
    writer.parquet(path)
    return read_clustered(events.sparkSession, path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def events_between(table: DataFrame, first: str, last: str) -> DataFrame:
    """Events of the days from `first` to `last`, both included; only their folders are listed and read."""
    return table.filter(F.col(DAY).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def events_of(table: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Events with one of a few values of a key; row groups without them are skipped."""
    return table.filter(F.col(column).isin(values))


def events_of_table(table: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Events whose key is in a table of keys.

    A semi join: where the keys are few, Spark sends them and filters the scan; where not, it shuffles both sides, and
    the runtime filter it may put before the shuffle drops what cannot match.
    """
    return table.join(wanted.select(column).distinct(), column, "left_semi")
