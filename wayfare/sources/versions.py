"""Tables that are replaced safely: a new version beside the old one, and a pointer moved when its rows are right.

A table is a folder with one hidden folder per version and a small file that names the current one. Readers follow the
file, so they see the old rows or the new rows, never half of them; a write that fails, or holds other rows than it was
given, leaves the old version as it was. Old versions and what failed writes left behind are removed after the move.
All file work goes through the Hadoop file system of the path, so any store Spark can write to will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER, VERSION = "_current.json", "_version-"  # hidden from readers of plain folders


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    store, place = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def _read_text(spark: SparkSession, path: str) -> str:
    store, place = _store(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode("utf-8")
    finally:
        stream.close()


def _swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside `path` and move over it in one step."""
    store, place = _store(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = store.create(beside)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, place, options)


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a table says: version, rows, schema; None where there is none."""
    place = f"{path}/{POINTER}"
    return json.loads(_read_text(spark, place)) if exists(spark, place) else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table; a plain Parquet folder is read as it is."""
    found = pointer(spark, path)
    if found is None:
        return spark.read.parquet(path)
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{path}/{found['version']}")


def replace_table(
    df: DataFrame,
    path: str,
    accept: Callable[[DataFrame], None] | None = None,
    keep: int = 0,
    expected: int | None = None,
) -> DataFrame:
    """Replace the table at `path` and return it as written.

    The rows of the new files are counted; another number than `expected` raises, and `accept` may raise for further
    reasons. Only then the pointer moves. `keep` earlier versions stay readable (by `version_of`), all others are
    removed.
    """
    spark = df.sparkSession
    before = pointer(spark, path)
    version = f"{VERSION}{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").parquet(f"{path}/{version}")
        table = spark.read.schema(df.schema).parquet(f"{path}/{version}")
        n = table.count()  # from the footers
        if expected is not None and n != expected:
            raise RuntimeError(f"{path}: {n} rows loaded, source has {expected}")
        if accept is not None:
            accept(table)
    except BaseException:
        delete(spark, f"{path}/{version}")
        raise
    earlier = [before["version"], *before["earlier"]][:keep] if before else []
    text = {"version": version, "rows": n, "schema": json.loads(df.schema.json()), "earlier": earlier}
    _swap_text(spark, f"{path}/{POINTER}", json.dumps(text))
    kept = {version, POINTER, *earlier}
    for name in children(spark, path):
        # Plain files are a table of before the versions; the pointer has replaced it.
        if name not in kept and not name.endswith(".crc"):
            delete(spark, f"{path}/{name}")
    return table


def version_of(spark: SparkSession, path: str, back: int = 1) -> DataFrame:
    """An earlier version that was kept: 1 is the one before the current."""
    found = pointer(spark, path)
    return spark.read.parquet(f"{path}/{found['earlier'][back - 1]}")
