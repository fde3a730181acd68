"""Token ids in Parquet list columns: ordered, with controlled row groups and page indexes.

Files are written by Spark's Parquet writer. Ids are dictionary or delta encoded (the writer's second format
version falls back to delta for integers), row groups and pages are small enough that a reader that asks for a few
documents, or for the metadata columns only, touches few pages: the page index is written for every column chunk.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.common import mapped_arrow
from wayfare.llm.tokens import encoder
from wayfare.session import shared_folder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
CACHE_WORDS = 900_000  # nothing else of this operator fills a worker
ROWS = 1024  # texts encoded at a time


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    dictionary: bool = False,
) -> None:
    """Write (doc_id, part, part_start, n_tokens, tokens) in ascending order of doc_id.

    Null ids come first; rows with the same id are ordered by a hash of their text. A null or empty text has
    the end id alone. `dictionary` chooses dictionary instead of delta encoding for the ids.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = encoder(tokenizer_path, CACHE_WORDS).many, 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, ends = encode(batch.column("text").to_pylist())
                # Each text's end id follows its ids.
                ends = ends + np.arange(1, batch.num_rows + 1)
                held = np.full(int(ends[-1]), end_id, dtype="<i4")
                inside = np.ones(len(held), bool)
                inside[ends - 1] = False
                held[inside] = ids.view("<i4")
                lengths = np.diff(np.append(0, ends))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.array(held))
                columns = [batch.column("doc_id"), batch.column("part"), pa.array(start + ends - lengths), pa.array(lengths), lists]
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "tokens"])

    schema = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    (
        mapped_arrow(ordered, encoded, schema)
        .write.mode("errorifexists")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens. Filters on doc_id reach the page index."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per partition of the write, each of many megabytes of ids.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return files.join(F.broadcast(firsts), "part").select(
        "doc_id", (F.col("first") + F.col("part_start")).alias("start"), "n_tokens", "tokens"
    )


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted from the ids), ids_crc32 of the ids as little-endian 32-bit integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = lists.values.to_numpy()
            bounds = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].astype("<i4", copy=False)) for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype("int64")), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped_arrow(
        tokens.select("doc_id", "start", "tokens"), summed, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents to the shared folder, read them back, and return their digests.

    An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/wayfare/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return digests(read_tokens(spark, path))
