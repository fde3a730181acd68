"""Surrogate keys: dense 8-byte numbers for long text keys, free of collisions.

A dictionary numbers the distinct texts of a key in order, over range slices, so that no task holds them all. Encoded
once, a log is grouped, joined and shuffled by 8-byte numbers through staging and marts, which do not look into their
keys; results get their texts back at the end. New texts are appended with higher numbers, so old numbers stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.ordered import FIND, heavy_keys, hot_keys, join_unique, keys_named, number_sliced
from wayfare.operators.staging import SESSION
from wayfare.session import written

SKU, PAGE = "product_sku_hash", "hashed_url"


def dictionary(*texts: DataFrame, slices: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(text, id): the distinct non-null texts of one-column tables, numbered from 0 without gaps.

    With `known`, an earlier dictionary, its numbers are kept and only new texts are numbered, after the last of them.
    """
    every = reduce(DataFrame.unionAll, [t.toDF("text") for t in texts]).filter("text is not null").distinct()
    start = 0
    if known is not None:
        every = every.join(known, "text", "left_anti")
        last = known.agg(F.max("id")).first()[0]
        start = 0 if last is None else last + 1
    numbered = number_sliced(every, [], [F.col("text")], "id", slices).select("text", (F.col("id") - 1 + start).alias("id"))
    numbered = written(numbered, "dictionary")
    return numbered if known is None else known.unionByName(numbered)


def encode(df: DataFrame, column: str, dictionary: DataFrame, hot: DataFrame | object | None = FIND) -> DataFrame:
    """`df` with the texts of `column` replaced by their numbers; null stays null. Every text must be known.

    A text with very many rows meets a broadcast of its one number, all others an ordinary join.
    """
    if hot is FIND:
        hot = hot_keys(df, [column])
    named = dictionary.select(F.col("text").alias(column), F.col("id").alias("__id"))
    joined = join_unique(df, named, [column], "left", hot)
    return joined.withColumn(column, F.col("__id")).drop("__id").select(*df.columns)


def encode_lists(
    df: DataFrame,
    columns: list[str],
    dictionary: DataFrame,
    row: str,
    others: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The same for list columns, in order; `row` is a column without nulls that tells the rows apart.

    The entries of all lists meet the dictionary in one join and come back in one grouping. The texts of the lists move
    with no row: `others`, which may encode further columns, and the last join have the other columns only.
    """
    none, empty = F.array().cast("array<string>"), F.array().cast("array<bigint>")

    def entries(k: int, column: str) -> Column:
        return F.transform(
            F.coalesce(column, none), lambda text, at: F.struct(F.lit(k).alias("list"), at.alias("at"), text.alias("text"))
        )

    every = F.concat(*[entries(k, column) for k, column in enumerate(columns)])
    place = df.select(F.col(row).alias("__row"), F.inline(every).alias("__list", "__at", "__text"))
    found = place.join(dictionary.select(F.col("text").alias("__text"), "id"), "__text", "left")
    pair = F.struct("__at", "id")
    lists = found.select("__row", "__list", "__at", "id").repartition("__row").groupBy("__row").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("__list") == k, pair))).alias(f"__list_{k}") for k in range(len(columns))]
    )
    rest = others(df.withColumns({column: F.col(column).isNotNull() for column in columns}))
    joined = rest.join(lists, rest[row] == F.col("__row"), "left")
    listed = {
        column: F.when(F.col(column), F.coalesce(F.col(f"__list_{k}")["id"], empty)) for k, column in enumerate(columns)
    }
    return joined.withColumns(listed).select(*df.columns)


def encode_list(df: DataFrame, column: str, dictionary: DataFrame, row: str) -> DataFrame:
    return encode_lists(df, [column], dictionary, row)


def decode(df: DataFrame, column: str, dictionary: DataFrame, hot: DataFrame | object | None = FIND) -> DataFrame:
    """`df` with numbers replaced by their texts; null stays null."""
    if hot is FIND:
        hot = hot_keys(df, [column])
    named = dictionary.select(F.col("id").alias(column), F.col("text").alias("__text"))
    joined = join_unique(df, named, [column], "left", hot)
    return joined.withColumn(column, F.col("__text")).drop("__text").select(*df.columns)


def encode_raw(
    browsing: DataFrame, search: DataFrame, catalog: DataFrame, slices: int | None = None
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(raw tables with 8-byte sessions, SKUs and pages; their dictionaries by column)."""
    listed = [search.select(F.explode(c)) for c in ("product_skus", "clicked_skus")]
    dictionaries = {
        SESSION: dictionary(browsing.select(SESSION), search.select(SESSION), slices=slices),
        SKU: dictionary(browsing.select(SKU), catalog.select(SKU), *listed, slices=slices),
        PAGE: dictionary(browsing.select(PAGE), slices=slices),
    }
    # The hot texts of all columns from one scan of the log.
    heavy = heavy_keys(browsing, {c: [c] for c in dictionaries})
    log = reduce(lambda df, c: encode(df, c, dictionaries[c], keys_named(heavy, c)), dictionaries, browsing)
    asked = encode_lists(
        search,
        ["product_skus", "clicked_skus"],
        dictionaries[SKU],
        "file_row_idx",
        lambda rows: encode(rows, SESSION, dictionaries[SESSION]),
    )
    tables = {
        "raw_browsing": written(log, "encoded-browsing"),
        "raw_search": written(asked, "encoded-search"),
        "raw_catalog": written(encode(catalog, SKU, dictionaries[SKU]), "encoded-catalog"),
    }
    return tables, dictionaries
