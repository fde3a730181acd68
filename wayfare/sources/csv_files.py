"""CSV ingest: pinned schemas, physical row order, parsed lists, vectors kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions import columns as c
from wayfare.operators.ordered import running_totals
from wayfare.session import written
from wayfare.sources.driver_tables import with_hierarchy


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TEXT, LONG = T.StringType(), T.LongType()

BROWSING_CSV = _schema(
    session_id_hash=TEXT,
    event_type=TEXT,
    product_action=TEXT,
    product_sku_hash=TEXT,
    server_timestamp_epoch_ms=LONG,
    hashed_url=TEXT,
)
SEARCH_CSV = _schema(
    session_id_hash=TEXT,
    query_vector=TEXT,
    clicked_skus_hash=TEXT,
    product_skus_hash=TEXT,
    server_timestamp_epoch_ms=LONG,
)
CATALOG_CSV = _schema(
    product_sku_hash=TEXT,
    description_vector=TEXT,
    category_hash=TEXT,
    image_vector=TEXT,
    price_bucket=TEXT,
)

# The file names of the three sources.
BROWSING_FILE, SEARCH_FILE, CATALOG_FILE = "browsing_train.csv", "search_train.csv", "sku_to_content.csv"

MAX_BLOCKS_BROADCAST = 200_000  # file splits whose offsets are sent to every executor
_PLACE = ["__file", "__block", "__row"]


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read CSV with a fixed schema; a bad value or a changed header raises instead of retyping."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def with_file_row_index(scanned: DataFrame, name: str = "file_row_idx") -> DataFrame:
    """Number the rows 0, 1, 2, ... in physical order (file path, block, line), without a global sort.

    Each row carries its block and a running id inside its task. The rows are written once, so both stay
    fixed; then one small row per block gives the number of rows before the block.
    """
    placed = scanned.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )
    landed = written(placed, "landed")
    key = ["__file", "__block"]
    blocks = landed.groupBy(*key).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    offsets = running_totals(blocks, [], [F.col("__file"), F.col("__block")], {"__n": "__upto"})
    offsets = written(
        offsets.select(*key, (F.col("__upto") - F.col("__n") - F.col("__first")).alias("__shift")), "offsets"
    )
    # Counted, not assumed: beyond the bound the runtime chooses the join.
    small = offsets.count() <= MAX_BLOCKS_BROADCAST
    indexed = landed.join(F.broadcast(offsets) if small else offsets, key)
    return indexed.withColumn(name, F.col("__row") + F.col("__shift")).drop(*_PLACE, "__shift")


def ingest_browsing(spark: SparkSession, path: str) -> DataFrame:
    rows = with_file_row_index(scan_csv(spark, path, BROWSING_CSV))
    text = [f.name for f in BROWSING_CSV if f.dataType == TEXT]
    return rows.withColumns({n: c.blank_to_null(n) for n in text}).select(
        "file_row_idx", *BROWSING_CSV.fieldNames()
    )


def ingest_search(spark: SparkSession, path: str, with_vectors: bool = False) -> dict[str, DataFrame]:
    """`raw_search`, and `raw_search_vectors` when asked for: the wide vectors never ride along."""
    scanned = scan_csv(spark, path, SEARCH_CSV)
    rows = with_file_row_index(scanned if with_vectors else scanned.drop("query_vector"))
    key = ["file_row_idx", c.blank_to_null("session_id_hash").alias("session_id_hash"), "server_timestamp_epoch_ms"]
    tables = {
        "raw_search": rows.select(
            *key,
            c.parse_list("product_skus_hash").alias("product_skus"),
            c.parse_list("clicked_skus_hash").alias("clicked_skus"),
        )
    }
    if with_vectors:
        tables["raw_search_vectors"] = rows.select(*key, c.parse_vector("query_vector").alias("query_vector"))
    return tables


def ingest_catalog(spark: SparkSession, path: str, with_vectors: bool = False) -> dict[str, DataFrame]:
    """`raw_catalog`, and `raw_catalog_vectors` when asked for. An unreadable price is NULL."""
    rows = scan_csv(spark, path, CATALOG_CSV)
    sku = c.blank_to_null("product_sku_hash").alias("product_sku_hash")
    price = c.blank_to_null("price_bucket").try_cast("double").alias("price_bucket")
    described = rows.select(sku, c.blank_to_null("category_hash").alias("category_hash"), price)
    tables = {"raw_catalog": with_hierarchy(described)}
    if with_vectors:
        tables["raw_catalog_vectors"] = rows.select(
            sku,
            c.parse_vector("description_vector").alias("description_vector"),
            c.parse_vector("image_vector").alias("image_vector"),
        )
    return tables
