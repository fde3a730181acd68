"""Tables of sessions bucketed by session, so that grouping and joining by session moves nothing.

A bucketed table keeps all rows of a session in one bucket. A session with a third of all rows would make one bucket,
and one task, of a third of the table; so the rows of hot sessions lie in a second table without buckets, written
in as many files as they need. What is computed per session is computed on both parts with the same functions: sessions
are never in both, so the results are simply put together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfare.operators.ordered import KEY_HASH, split_hot
from wayfare.operators.staging import SESSION

ORDINARY, HOT, LAYOUT = "ordinary", "hot", "_layout"


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write `df` in `buckets` buckets by `keys` and return it as written; an existing table at `path` raises.

    Rows that are dealt that way already (by `repartition(buckets, *keys)`) are not moved again.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    # The catalog of a session forgets; the layout beside the table does not.
    layout = spark.createDataFrame([(keys, buckets, df.schema.json())], "keys array<string>, buckets int, schema string")
    layout.coalesce(1).write.mode("overwrite").json(f"{path}{LAYOUT}")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of `write_bucketed`, also one of an earlier session, with its buckets known to the planner."""
    row = spark.read.schema("keys array<string>, buckets int, schema string").json(f"{path}{LAYOUT}").first()
    name = f"bucketed_{uuid.uuid4().hex}"
    fields = StructType.fromJson(json.loads(row["schema"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    by = ", ".join(f"`{k}`" for k in row["keys"])
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {row['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name)


class SessionTables:
    """Session tables under one folder, all in the same number of buckets and with the same sessions apart.

    `hot` holds hashes of hot sessions (`hot_keys`); a session that is hot in one table is kept apart in all of them.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, hot: DataFrame | None = None) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.hot = None if hot is None else hot.select(KEY_HASH).distinct()
        self._parts: dict[str, tuple[DataFrame, DataFrame | None]] = {}

    def put(self, name: str, df: DataFrame, key: str = SESSION) -> None:
        large, ordinary = split_hot(df, [key], self.hot)
        self.put_parts(name, ordinary, large, key)

    def put_parts(self, name: str, ordinary: DataFrame, large: DataFrame | None, key: str = SESSION) -> None:
        """Tables whose hot sessions are apart already."""
        path = f"{self.folder}/{name}"
        table = write_bucketed(ordinary, f"{path}/{ORDINARY}", [key], self.buckets)
        if large is not None:
            large.write.mode("errorifexists").parquet(f"{path}/{HOT}")
            large = self.spark.read.schema(large.schema).parquet(f"{path}/{HOT}")
        self._parts[name] = (table, large)

    def open(self, name: str, with_hot: bool) -> None:
        """Take up a table that an earlier session wrote."""
        path = f"{self.folder}/{name}"
        large = self.spark.read.parquet(f"{path}/{HOT}") if with_hot else None
        self._parts[name] = (open_bucketed(self.spark, f"{path}/{ORDINARY}"), large)

    def table(self, name: str) -> DataFrame:
        ordinary, large = self._parts[name]
        return ordinary if large is None else ordinary.unionByName(large)

    def per_session(self, operator: Callable[..., DataFrame], *names: str) -> DataFrame:
        """`operator` over the named tables, for ordinary and for hot sessions; its result has rows per session."""
        result = operator(*[self._parts[n][0] for n in names])
        parts = [self._parts[n] for n in names]
        if all(large is None for _, large in parts):
            return result
        empty = [large if large is not None else ordinary.filter(F.lit(False)) for ordinary, large in parts]
        return result.unionByName(operator(*empty))
