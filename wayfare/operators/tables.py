"""Small helpers for report tables: one-row metric tables, label columns, stacked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row tables with different columns into one row, without a join."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*[F.max(name).alias(name) for part in parts for name in part.columns])


def stacked(row: DataFrame, names: list[str], records: list[tuple[Column, ...]]) -> DataFrame:
    """Turn the columns of a one-row table into rows: one record of columns per output row."""
    entries = [F.struct(*[col.alias(n) for n, col in zip(names, r)]) for r in records]
    return row.select(F.inline(F.array(*entries)))
