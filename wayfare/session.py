"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Recommended for a cluster. Nothing in the library depends on them for right results:
# timestamps are zone-free and every division is guarded.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wayfare")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    `spark.checkpoint.dir` (or a checkpoint folder already set on the context) wins. A folder of
    our own is made only for a local master, where driver and executors share one disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.partition("[")[0] == "local":  # a local cluster has executors of its own
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="wayfare-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_WRITTEN: dict[str, list[str]] = {}  # application -> folders of its intermediate tables


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside the block when it ends; what reads them must have run by then."""
    from wayfare.sources.versions import delete

    paths = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    try:
        yield
    finally:
        for path in paths[before:]:
            delete(spark, path)
        del paths[before:]


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` once to the shared folder and read it back.

    Lost executors cannot take the table with them, and a value that depends on the run
    (such as a partition number) is fixed by the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wayfare/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
