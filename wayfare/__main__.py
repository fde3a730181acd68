"""Command line: build the warehouse from CSV files, write reports, load and verify the serving copy.

    spark-submit ... -m wayfare build   --raw hdfs://raw --warehouse hdfs://wh [--only search] [--with-vectors]
    python -m wayfare report  --warehouse DIR --out DIR [--report funnel ...]
    python -m wayfare load    --warehouse DIR --serving DIR
    python -m wayfare verify  --warehouse DIR --serving DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wayfare.operators import quality
from wayfare.plans.reports import REPORTS, run_report
from wayfare.plans.warehouse import RAW_TABLES, of_csv, of_tables
from wayfare.session import SETTINGS, released
from wayfare.sources import csv_files, sinks

SOURCES = {"browsing": "raw_browsing", "search": "raw_search", "catalog": "raw_catalog"}


def build(spark: SparkSession, args: argparse.Namespace) -> int:
    warehouse = of_csv(spark, args.raw, args.warehouse)
    if args.with_vectors:
        write_vectors(spark, args)
    if args.only:
        print(f"{SOURCES[args.only]}: {warehouse[SOURCES[args.only]].count()} rows")
        return 0
    for name in RAW_TABLES:
        warehouse.table(name)
    for name, table in warehouse.build_all().items():
        print(f"{name}: {table.count()} rows")
    terms = quality.reconcile(warehouse["raw_browsing"], warehouse["stg_browsing"]).orderBy("step").collect()
    for row in terms:
        print(f"  {row['term']:<34}{row['n_rows']:>16,}")
    # Rows that left for no named reason make every number after them doubtful.
    return 0 if terms[-1]["n_rows"] == 0 else 1


def write_vectors(spark: SparkSession, args: argparse.Namespace) -> None:
    search = csv_files.ingest_search(spark, f"{args.raw}/{csv_files.SEARCH_FILE}", with_vectors=True)
    catalog = csv_files.ingest_catalog(spark, f"{args.raw}/{csv_files.CATALOG_FILE}", with_vectors=True)
    for name, table in {**search, **catalog}.items():
        if name.endswith("_vectors"):
            sinks.write_table(table, f"{args.warehouse}/{name}")


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    tables = of_tables(spark, args.warehouse)
    for name in args.report or list(REPORTS):
        for folder in run_report(name, tables, args.out):
            print(folder)
    return 0


def load(spark: SparkSession, args: argparse.Namespace) -> int:
    tables = of_tables(spark, args.warehouse)
    sinks.load_serving({n: tables[n] for n in sinks.CONTRACTS}, args.serving).show(truncate=False)
    return 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    house, copy = of_tables(spark, args.warehouse), sinks.read_serving(spark, args.serving)
    compared = quality.parity(quality.parity_values(house), quality.parity_values(copy))
    compared.orderBy("label").show(50, truncate=False)
    return 0 if compared.filter("not matches").isEmpty() else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayfare", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, action, needs in (
        ("build", build, ("raw", "warehouse")),
        ("report", report, ("warehouse", "out")),
        ("load", load, ("warehouse", "serving")),
        ("verify", verify, ("warehouse", "serving")),
    ):
        command = commands.add_parser(name)
        command.set_defaults(action=action)
        for need in needs:
            command.add_argument(f"--{need}", required=True)
        if name == "build":
            command.add_argument("--only", choices=sorted(SOURCES))
            command.add_argument("--with-vectors", action="store_true")
        if name == "report":
            command.add_argument("--report", nargs="*", choices=sorted(REPORTS))
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("wayfare")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    with released(spark):  # nothing of a finished run stays but its tables
        return args.action(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
