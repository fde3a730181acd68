"""The tables in dependency order, each built once and read back by what comes after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfare.operators import cells, comparison, features, funnel, marts, model, quality, staging, surrogates
from wayfare.operators.ordered import heavy_keys, keys_named
from wayfare.operators.staging import SESSION
from wayfare.session import written
from wayfare.sources.bucketed import SessionTables
from wayfare.sources import driver_tables
from wayfare.sources.csv_files import (
    BROWSING_FILE,
    CATALOG_FILE,
    SEARCH_FILE,
    ingest_browsing,
    ingest_catalog,
    ingest_search,
)
from wayfare.sources.sinks import write_table
from wayfare.sources.versions import current


TABLES = [
    "session_profile",
    "stg_browsing",
    "stg_search",
    "dim_product",
    "fct_session",
    "fct_product_performance",
    "ml_cart_sessions",
]
RAW_TABLES = ["raw_browsing", "raw_search", "raw_catalog"]


class Warehouse:
    """Raw tables in, staged tables and marts out.

    `table(name)` is lazy: a staged table or mart is written when first asked for and read back by everything
    downstream. It goes to `target/name`, replacing what is there, or without a target to the shared folder.
    `keep` names raw tables that are written as well, because making them costs more than reading them.
    `session_cells`, `session_medians`, the rows and scores of the models and `model_comparison` are made when a report
    asks for them; each model is fitted once. `refresh()` forgets what was built.
    """

    def __init__(
        self,
        raw: dict[str, Callable[[], DataFrame]],
        target: str | None = None,
        keep: tuple[str, ...] = (),
        hot_rows: int | None = None,
        slices: int | None = None,
    ) -> None:
        self._raw = raw
        self._target = target
        self._keep = keep
        self._hot_rows = hot_rows
        self._slices = slices
        self._built: dict[str, DataFrame] = {}
        self._fitted: dict = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    __getitem__ = table

    def refresh(self) -> None:
        self._built.clear()
        self._fitted.clear()

    def build_all(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def _build(self, name: str) -> DataFrame:
        if name in self._raw:
            df = self._raw[name]()
            return self._write(df, name) if name in self._keep else df
        return self._write(self.define(name), name)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if self._target is None else write_table(df, f"{self._target}/{name}")

    def heavy_sessions(self) -> DataFrame:
        """The hot sessions of the raw log, found once for all tables that are made from it."""
        if "heavy" not in self._built:
            self._built["heavy"] = heavy_keys(self["raw_browsing"], {"session": [SESSION]}, self._hot_rows)
        return self._built["heavy"]

    def fitted(self, name: str):
        """The logistic or the boosting model of the prepared carts."""
        if name not in self._fitted:
            fit = {"logistic": model.fit_logistic, "boosting": model.fit_gbt}[name]
            self._fitted[name] = fit(self["model_rows"])
        return self._fitted[name]

    def define(self, name: str) -> DataFrame:
        """The query that makes a table from the tables before it, not yet run."""
        if name == "session_profile":
            return quality.session_profile(self["raw_browsing"], self._hot_rows, self._slices, self.heavy_sessions())
        if name == "stg_browsing":
            return staging.stage_browsing(self["raw_browsing"], self._hot_rows, self._slices, self.heavy_sessions())
        if name == "stg_search":
            return staging.stage_search(self["raw_search"])
        if name == "dim_product":
            return staging.product_dimension(self["stg_browsing"], self["raw_catalog"])
        if name == "fct_session":
            return marts.session_fact(self["stg_browsing"], self["stg_search"])
        if name == "fct_product_performance":
            return marts.product_performance(self["stg_browsing"], self["dim_product"])
        if name == "ml_cart_sessions":
            return features.cart_sessions(
                self["stg_browsing"], self["stg_search"], self["dim_product"], self._hot_rows
            )
        if name == "session_cells":
            return cells.session_cells(self["fct_session"])
        if name == "session_medians":
            return funnel.session_medians(self["fct_session"])
        if name == "model_rows":
            return model.prepared(self["ml_cart_sessions"], self._slices)
        if name == "leaky_rows":
            return model.leaky_rows(self["fct_session"], model.WHOLE_SESSION, self._slices)
        if name == "logistic_scores":
            return model.scored_rows(self.fitted("logistic"), self["model_rows"])
        if name == "boosting_scores":
            return model.boosting_scores(self.fitted("boosting"), self["model_rows"])
        if name == "leaky_scores":
            return model.leaky_scores(self["leaky_rows"])
        if name == "model_scores":
            parts = [self[t] for t in ("ml_cart_sessions", "logistic_scores", "boosting_scores", "leaky_scores")]
            return comparison.model_scores(*parts, self._slices)
        if name == "model_comparison":
            return comparison.compared(self["model_scores"], self._slices)
        raise KeyError(name)


def session_tables(warehouse: Warehouse, folder: str, buckets: int, hot_rows: int | None = None) -> SessionTables:
    """Events and searches of the warehouse's raw log, bucketed by session under `folder`.

    Staging deals the events to the buckets with its one shuffle; searches are moved once. From then on, what is
    grouped or joined by session stays where it is: `session_marts`.
    """
    raw, searches = warehouse["raw_browsing"], staging.stage_search(warehouse["raw_search"])
    heavy = heavy_keys(raw, {"session": [SESSION]}, hot_rows)
    many = heavy_keys(searches, {"session": [SESSION]}, hot_rows)
    hot = keys_named(heavy.unionByName(many), "session")
    tables = SessionTables(raw.sparkSession, folder, buckets, hot)
    tables.put_parts("stg_browsing", *staging.stage_parts(raw, tables.hot, parts=buckets))
    tables.put("stg_search", searches)
    return tables


def session_marts(tables: SessionTables, dimension: DataFrame) -> dict[str, DataFrame]:
    """The marts with one row per session, from bucketed tables: no row moves by session."""

    def carts(staged: DataFrame, searches: DataFrame) -> DataFrame:
        return features.cart_sessions(staged, searches, dimension, hot=None, bucketed=True)

    return {
        "fct_session": tables.per_session(marts.session_fact, "stg_browsing", "stg_search"),
        "ml_cart_sessions": tables.per_session(carts, "stg_browsing", "stg_search"),
    }


def with_surrogates(warehouse: Warehouse) -> tuple[Warehouse, dict[str, DataFrame]]:
    """(a warehouse over the same raw tables with 8-byte keys; the dictionaries that turn them back into texts)."""
    raw, dictionaries = surrogates.encode_raw(*[warehouse[n] for n in RAW_TABLES])
    return Warehouse({n: lambda n=n: raw[n] for n in RAW_TABLES}), dictionaries


def of_tables(spark: SparkSession, folder: str) -> Warehouse:
    """The tables an earlier run wrote to `folder`; scores of the models are made when asked for."""
    return Warehouse({n: lambda n=n: current(spark, f"{folder}/{n}") for n in [*RAW_TABLES, *TABLES]})


def of_csv(spark: SparkSession, folder: str, target: str) -> Warehouse:
    """The warehouse over the three CSV files in `folder`, written to `target`."""
    return Warehouse(
        {
            "raw_browsing": lambda: ingest_browsing(spark, f"{folder}/{BROWSING_FILE}"),
            "raw_search": lambda: ingest_search(spark, f"{folder}/{SEARCH_FILE}")["raw_search"],
            "raw_catalog": lambda: ingest_catalog(spark, f"{folder}/{CATALOG_FILE}")["raw_catalog"],
        },
        target,
        keep=tuple(RAW_TABLES),
    )


_OPEN: dict[tuple[str, str], Warehouse] = {}


def of_driver_tables(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse over the given tables; one per application and folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Warehouse(
            {
                "raw_browsing": lambda: driver_tables.raw_browsing(spark, sf_dir),
                "raw_search": lambda: driver_tables.raw_search(spark, sf_dir),
                "raw_catalog": lambda: driver_tables.raw_catalog(spark, sf_dir),
            },
            keep=("raw_search",),
        )
    return _OPEN[key]
