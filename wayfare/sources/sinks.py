"""Writers: materialised marts, CSV export, the checked load of the serving copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.marts import PRODUCT_COLUMNS, SESSION_COLUMNS
from wayfare.operators.quality import constraint_violations
from wayfare.sources.versions import current, replace_table

TEXT, LONG, DOUBLE, FLAG, TIME = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)
NULL_TEXT = "\\N"


def _contract(kinds: dict[str, T.DataType], names: list[str], default: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kinds.get(n, default)) for n in names])


_SESSION_FLAGS = [
    "reached_session", "reached_detail", "reached_add", "reached_purchase", "strict_detail",
    "strict_add", "strict_purchase", "purchase_without_add", "is_bounce", "cart_abandoned",
    "cart_emptied", "used_search", "had_duplicate_events",
]
_SECONDS = [
    "duration_sec_raw", "duration_sec_capped", "sec_to_first_add", "sec_to_purchase",
    "sec_add_to_purchase",
]

# Declared columns and types of the served tables, dimension first: the product mart refers to it.
CONTRACTS: dict[str, T.StructType] = {
    "dim_product": _contract(
        {"in_catalog": FLAG, "has_price": FLAG, "category_depth": LONG, "price_bucket": DOUBLE},
        [
            "product_sku_hash", "in_catalog", "category_lvl1", "category_lvl2", "category_lvl3",
            "category_hash", "category_depth", "price_bucket", "has_price", "price_tier",
        ],
        TEXT,
    ),
    "fct_session": _contract(
        {
            "session_id_hash": TEXT,
            "session_start": TIME,
            "session_end": TIME,
            **dict.fromkeys(_SESSION_FLAGS, FLAG),
            **dict.fromkeys(_SECONDS, DOUBLE),
        },
        SESSION_COLUMNS,
        LONG,
    ),
    "fct_product_performance": _contract(
        {
            **dict.fromkeys(["product_sku_hash", "category_lvl1", "category_lvl2", "price_tier"], TEXT),
            **dict.fromkeys(
                ["price_bucket", "view_to_add_rate", "add_to_purchase_rate", "view_to_purchase_rate"], DOUBLE
            ),
            "in_catalog": FLAG,
        },
        PRODUCT_COLUMNS,
        LONG,
    ),
}


def enforce_contract(df: DataFrame, contract: T.StructType, name: str = "table") -> DataFrame:
    """`df` with exactly the declared columns in order; a missing, extra or retyped column raises."""
    actual = {f.name: f.dataType for f in df.schema}
    declared = {f.name: f.dataType for f in contract}
    problems = [f"missing {n}" for n in declared if n not in actual]
    problems += [f"undeclared {n}" for n in actual if n not in declared]
    problems += [
        f"{n} is {actual[n].simpleString()}, declared {kind.simpleString()}"
        for n, kind in declared.items()
        if n in actual and actual[n] != kind
    ]
    if problems:
        raise ValueError(f"{name} breaks its contract: {'; '.join(problems)}")
    return df.select(*declared)


def write_table(
    df: DataFrame, path: str, accept: Callable[[DataFrame], None] | None = None, expected: int | None = None
) -> DataFrame:
    """Replace the table at `path` and return it as written; readers follow the pointer (`versions.current`)."""
    return replace_table(df, path, accept, expected=expected)


def export_csv(df: DataFrame, contract: T.StructType, path: str, header: bool = False) -> None:
    """Distributed CSV with an explicit column list; NULL is written as \\N, so '' stays apart."""
    chosen = df.select(*contract.fieldNames())
    chosen.write.mode("overwrite").option("header", header).option("nullValue", NULL_TEXT).option(
        "escape", '"'
    ).csv(path)


def read_export(spark: SparkSession, contract: T.StructType, path: str, header: bool = False) -> DataFrame:
    return (
        spark.read.schema(contract)
        .option("header", header)
        .option("nullValue", NULL_TEXT)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def load_serving(marts: dict[str, DataFrame], target: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Replace the serving copy of the three marts, dimension first; one row per table.

    Marts that break a rule of the serving schema are not loaded: the call raises and names the rules.
    Each table is written as Parquet under `target`, or through JDBC when connection options are given. A copy
    whose row count differs from its source raises before it replaces the one before: a partial load is worse than none.
    """
    spark = next(iter(marts.values())).sparkSession
    rules = constraint_violations(marts["fct_session"], marts["fct_product_performance"], marts["dim_product"])
    broken = {r["rule"]: r["violations"] for r in rules.filter("violations > 0").collect()}  # one row per rule
    if broken:
        raise RuntimeError(f"not loaded, rules are broken: {broken}")
    report = None
    for name, contract in CONTRACTS.items():
        source = enforce_contract(marts[name], contract, name)
        expected = source.count()
        if jdbc is None:
            copy = write_table(source, f"{target}/{name}", expected=expected)
        else:
            options = {**jdbc, "dbtable": f"{target}.{name}"}
            source.write.format("jdbc").options(**options).option("truncate", True).mode("overwrite").save()
            copy = spark.read.format("jdbc").options(**options).load()
        loaded = copy.count()
        if expected != loaded:
            raise RuntimeError(f"{name}: {loaded} rows loaded, source has {expected}")
        row = copy.agg(F.count(F.lit(1)).alias("loaded_rows")).select(
            F.lit(name).alias("table_name"), F.lit(expected).cast("bigint").alias("source_rows"), "loaded_rows"
        )
        report = row if report is None else report.unionByName(row)
    return report


def read_serving(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    return {n: enforce_contract(current(spark, f"{target}/{n}"), s, n) for n, s in CONTRACTS.items()}
