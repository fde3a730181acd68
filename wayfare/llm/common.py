"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A row number that is unique, not dense. Write the result before relying on it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(taken: list[str], name: str) -> str:
    """A name for a helper column that no column of the input has, upper and lower case being the same."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Arrow batches cut into slices, so that a few hundred texts are worked on at a time."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the Python path of the workers, whatever folder the driver was started in."""
    environment = spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the large table that was asked for last, and no other.

    A worker serves one stage after the other, so the tables of all stages of a job would pile up in it.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def mapped(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """`mapInPandas` without empty batches, whose columns have no types. A worker that waits for its next task holds no
    freed Arrow memory."""
    let_workers_import(df.sparkSession)

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (out for out in function(batches) if len(out))
        pa.default_memory_pool().release_unused()

    return df.mapInPandas(filled, schema)


def mapped_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    let_workers_import(df.sparkSession)
    return df.mapInArrow(function, schema)
