"""Every registered query: name -> function of (spark, folder of the given tables).

Each reads the whole tables. Staged tables and marts are shared through the warehouse; a query named after
a table runs that table's own definition over the tables before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators import (
    comparison,
    features,
    incremental,
    marts,
    metrics,
    model,
    parity,
    quality,
    staging,
    surrogates,
)
from wayfare.operators.ordered import heavy_keys, hot_keys, number_rows
from wayfare.operators.staging import SESSION, TS
from wayfare.plans.reports import REPORTS
from wayfare.plans.warehouse import Warehouse, of_driver_tables, session_marts, session_tables, with_surrogates
from wayfare.session import shared_folder, written
from wayfare.sources import clustered, csv_files, driver_tables, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def on_tables(name: str, operator: Callable[..., DataFrame], *tables: str) -> None:
    """Register an operator over warehouse tables."""
    QUERIES[name] = lambda spark, sf_dir: operator(
        *[of_driver_tables(spark, sf_dir)[t] for t in tables]
    )


def own_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/wayfare/{label}-{uuid.uuid4().hex}"


def joined(array: str) -> F.Column:
    """Arrays are shown as text in results."""
    return F.array_join(array, ",").alias(array)


# --- sources and sinks --------------------------------------------------------------------------


@query("scan_csv_pinned")
def scan_csv_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_folder(spark, "browsing-csv")
    raw = driver_tables.raw_browsing(spark, sf_dir).select(*csv_files.BROWSING_CSV.fieldNames())
    raw.write.option("header", True).csv(path)
    text = [f.name for f in csv_files.BROWSING_CSV if f.name != TS]
    scanned = csv_files.scan_csv(spark, path, csv_files.BROWSING_CSV)
    return scanned.withColumns({n: c.blank_to_null(n) for n in text})


@query("file_row_index")
def file_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_folder(spark, "events-csv")
    events = driver_tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    # Range parts, each sorted: the file order is the id order, over several files.
    events.repartitionByRange("event_id").sortWithinPartitions("event_id").write.option("header", True).csv(path)
    scanned = csv_files.scan_csv(spark, path, events.schema)
    return csv_files.with_file_row_index(scanned).select("file_row_idx", "event_id", "event_type")


@query("normalize_blanks")
def normalize_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = driver_tables.table(spark, sf_dir, "events")
    padded = F.when(F.col("event_type") == "signup", F.lit("   ")).otherwise(
        F.concat(F.lit("  "), "event_type", F.lit(" "))
    )
    cleaned = events.select(c.blank_to_null(padded).alias("cleaned"))
    return cleaned.groupBy("cleaned").agg(F.count(F.lit(1)).alias("n_rows"))


@query("parse_list_literal")
def parse_list_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = of_driver_tables(spark, sf_dir)["raw_search"]
    literal = raw.select("file_row_idx", *[c.format_list(n).alias(n) for n in ("product_skus", "clicked_skus")])
    return literal.select(
        "file_row_idx",
        *[F.array_join(c.parse_list(n), ",").alias(n) for n in ("product_skus", "clicked_skus")],
        *[F.array_size(c.parse_list(n)).cast("bigint").alias(f"n_{n}") for n in ("product_skus", "clicked_skus")],
    )


def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = driver_tables.table(spark, sf_dir, "embeddings")
    wide = F.col("embedding").cast("array<double>").cast("array<string>")
    return vectors.select(
        "vec_id",
        F.col("label").cast("bigint").alias("label"),
        F.concat(F.lit("["), F.array_join(wide, ", "), F.lit("]")).alias("literal"),
    )


@query("parse_vector_literal")
def parse_vector_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = vector_text(spark, sf_dir).withColumn("v", c.parse_vector("literal"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return parsed.select(
        "vec_id",
        F.array_size("v").cast("bigint").alias("dims"),
        F.get("v", F.lit(0)).alias("first"),
        F.element_at("v", -1).alias("last"),
        F.round(total, 6).alias("total"),
    )


@query("vector_table")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in their own table: the narrow part is read without touching them."""
    rows = vector_text(spark, sf_dir)
    vectors = sinks.write_table(
        rows.select("vec_id", c.parse_vector("literal").alias("query_vector")), own_folder(spark, "vectors")
    )
    narrow = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    longest = vectors.join(rows.select("vec_id", "label"), "vec_id").groupBy("label").agg(
        F.max(F.array_size("query_vector")).cast("bigint").alias("dims"),
        F.count("query_vector").alias("n_vectors"),
    )
    return narrow.join(longest, "label")


@query("category_hierarchy")
def category_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = driver_tables.table(spark, sf_dir, "part")
    third = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
    path = F.when(F.col("p_partkey") % 2 != 0, F.concat_ws("/", "p_type", "p_brand", third))
    split = parts.select("p_partkey", path.alias("category_hash")).withColumns(c.hierarchy("category_hash"))
    return split.select(
        "p_partkey", joined("category_path"), "category_lvl1", "category_lvl2", "category_lvl3", "category_depth"
    )


@query("catalog_ingest")
def catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows through CSV; every seventh price is unreadable and must become NULL."""
    path = own_folder(spark, "catalog-csv")
    key = F.col("p_partkey")
    text = driver_tables.table(spark, sf_dir, "part").select(
        key.cast("string").alias("product_sku_hash"),
        F.lit(None).cast("string").alias("description_vector"),
        F.when(key % 2 != 0, F.concat_ws("/", "p_type", "p_brand")).alias("category_hash"),
        F.lit(None).cast("string").alias("image_vector"),
        F.when(key % 7 == 0, "n/a").when(key % 2 != 0, F.concat((1 + key % 10).cast("string"), F.lit(".0"))).alias(
            "price_bucket"
        ),
    )
    text.write.option("header", True).csv(path)
    catalog = csv_files.ingest_catalog(spark, path)["raw_catalog"]
    return catalog.withColumn("category_path", F.array_join("category_path", ","))


@query("write_mart")
def write_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a mart twice to one place; the second write replaces the first."""
    sessions = of_driver_tables(spark, sf_dir)["fct_session"]
    path = own_folder(spark, "mart")
    sinks.write_table(sessions, path)
    again = sinks.write_table(sessions, path)
    return again.groupBy("day_of_week").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n_events").alias("n_events")
    )


@query("export_csv")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = sinks.CONTRACTS["fct_session"]
    path = own_folder(spark, "export")
    sinks.export_csv(of_driver_tables(spark, sf_dir)["fct_session"], contract, path)
    return sinks.read_export(spark, contract, path)


def served(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, str, DataFrame]:
    warehouse = of_driver_tables(spark, sf_dir)
    target = own_folder(spark, "serving")
    report = sinks.load_serving({n: warehouse[n] for n in sinks.CONTRACTS}, target)
    return warehouse, target, report


@query("load_serving")
def load_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir)[2]


@query("parity_check")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse, target, _ = served(spark, sf_dir)
    copy = sinks.read_serving(spark, target)
    compared = quality.parity(quality.parity_values(warehouse), quality.parity_values(copy))
    return compared.select("label", F.col("left_value").alias("value"), "matches")


@query("schema_contract")
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null values per declared column of each served table, after the contract is enforced."""
    warehouse = of_driver_tables(spark, sf_dir)
    reports = []
    for name, contract in sinks.CONTRACTS.items():
        held = sinks.enforce_contract(warehouse[name], contract, name)
        row = held.agg(*[F.count(n).alias(n) for n in held.columns])
        cells = F.array(
            *[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("n_values")) for f in contract]
        )
        reports.append(row.select(F.lit(name).alias("table_name"), F.inline(cells)))
    return reduce(DataFrame.unionByName, reports)


# --- staging --------------------------------------------------------------------------------------


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.usable_events(driver_tables.raw_browsing(spark, sf_dir))


@query("row_fingerprint")
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = usable(spark, sf_dir).groupBy(c.fingerprint(c.EVENT_COLUMNS).alias("fp")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return prints.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


QUERIES["dedup_events"] = lambda spark, sf: staging.dedup_events(usable(spark, sf))
QUERIES["dedup_two_stage"] = lambda spark, sf: staging.dedup_events_by_fingerprint(usable(spark, sf))
QUERIES["pdp_double_fire"] = lambda spark, sf: staging.collapse_double_fire_spread(
    staging.dedup_events(usable(spark, sf))
)


@query("event_sequence")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usable(spark, sf_dir).select(SESSION, TS, "file_row_idx")
    order = [F.col(TS), F.col("file_row_idx")]
    return number_rows(events, [SESSION], order, "event_seq", hot_keys(events, [SESSION]))


@query("time_features")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(spark, sf_dir).select(
        "file_row_idx",
        c.event_time(TS).alias("event_ts"),
        c.day_of_week(TS).alias("day_of_week"),
        c.hour_of_day(TS).alias("hour_of_day"),
    )


@query("funnel_stage")
def funnel_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = usable(spark, sf_dir).select("product_action", c.funnel_stage().alias("funnel_stage"))
    return staged.groupBy("product_action", "funnel_stage").agg(F.count(F.lit(1)).alias("events"))


QUERIES["stg_browsing"] = (
    lambda spark, sf: of_driver_tables(spark, sf).define("stg_browsing").select(*staging.STAGED_COLUMNS)
)


@query("stg_search")
def stg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("result_skus", "clicked_skus", "valid_clicked_skus")
    staged = of_driver_tables(spark, sf_dir).define("stg_search")
    return staged.withColumns({n: F.array_join(n, ",") for n in lists})


for _table in ("session_profile", "dim_product", "fct_session", "fct_product_performance", "ml_cart_sessions"):
    QUERIES[_table] = lambda spark, sf, name=_table: of_driver_tables(spark, sf).define(name)

on_tables("reconcile", quality.reconcile, "raw_browsing", "stg_browsing")

# --- marts and features -----------------------------------------------------------------------------

on_tables("session_rollup", marts.session_rollup, "stg_browsing")
on_tables("session_search_rollup", marts.session_search_rollup, "stg_search")


def session_columns(name: str, make: Callable[[], dict]) -> None:
    """Register one group of session columns over the roll-up."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rolled = marts.session_rollup(of_driver_tables(spark, sf_dir)["stg_browsing"])
        return rolled.select(SESSION, *[column.alias(n) for n, column in make().items()])

    QUERIES[name] = run


session_columns("session_duration", marts.duration_columns)
session_columns("funnel_attained", marts.attained_columns)
session_columns("funnel_strict", marts.strict_columns)
session_columns("session_outcomes", marts.outcome_columns)
session_columns("session_timing", marts.timing_columns)
on_tables("first_add", features.first_add, "stg_browsing")
on_tables("truncated_features", features.truncated_features, "stg_browsing")
on_tables("cart_label", features.cart_label, "stg_browsing")
on_tables(
    "pre_search_features",
    lambda staged, searches: features.pre_search_features(features.first_add(staged), searches),
    "stg_browsing",
    "stg_search",
)
on_tables(
    "assert_constraints",
    quality.constraint_violations,
    "fct_session",
    "fct_product_performance",
    "dim_product",
)

# --- parity ---------------------------------------------------------------------------------------


@query("row_parity")
def row_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the session fact and a copy with a changed cell, a lost row and a new row."""
    fact = of_driver_tables(spark, sf_dir)["fct_session"]
    ends = fact.agg(F.min(SESSION).alias("first"), F.max(SESSION).alias("last")).first()
    one_more = F.when(F.col(SESSION) == ends["last"], F.col("n_adds") + 1).otherwise(F.col("n_adds"))
    copy = fact.filter(F.col(SESSION) != ends["first"]).withColumn("n_adds", one_more)
    new = fact.filter(F.col(SESSION) == ends["first"]).withColumn(SESSION, F.lit("not in the fact"))
    return parity.differences(fact, written(copy.unionByName(new), "copy"), [SESSION])


# --- updates --------------------------------------------------------------------------------------

_BEFORE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def updated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables after the last tenth of the log came in, from a build over what was there before; once per folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _BEFORE:
        house = of_driver_tables(spark, sf_dir)
        log, asked, catalog = house["raw_browsing"], house["raw_search"], house["raw_catalog"]
        ends = [t.agg(F.max("file_row_idx")).first()[0] * 9 // 10 for t in (log, asked)]
        old, old_asked = (t.filter(F.col("file_row_idx") <= end) for t, end in zip((log, asked), ends))
        new, new_asked = (t.filter(F.col("file_row_idx") > end) for t, end in zip((log, asked), ends))
        before = Warehouse({"raw_browsing": lambda: old, "raw_search": lambda: old_asked, "raw_catalog": lambda: catalog})
        kept = {n: before[n] for n in incremental.KEPT if n != "product_counts"}
        kept["product_counts"] = marts.product_counts(before["stg_browsing"])
        _BEFORE[key] = incremental.update(kept, old, new, new_asked, catalog)
    return _BEFORE[key]


def on_update(table: str) -> Query:
    return lambda spark, sf_dir: updated(spark, sf_dir)[table]


for _mart in ("fct_session", "fct_product_performance", "dim_product", "ml_cart_sessions"):
    QUERIES[f"updated_{_mart}"] = on_update(_mart)

# --- clustered layout -----------------------------------------------------------------------------

_CLUSTERED: dict[tuple[str, str], DataFrame] = {}


def clustered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _CLUSTERED:
        staged = of_driver_tables(spark, sf_dir)["stg_browsing"].select(*staging.STAGED_COLUMNS)
        _CLUSTERED[key] = clustered.write_clustered(staged, own_folder(spark, "clustered"))
    return _CLUSTERED[key]


@query("clustered_day")
def clustered_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per stage of the first day of the log, read from that day's folder."""
    table = clustered_events(spark, sf_dir)
    day = table.agg(F.min(clustered.DAY)).first()[0].isoformat()
    return clustered.events_between(table, day, day).groupBy("funnel_stage").agg(F.count(F.lit(1)).alias("events"))


@query("clustered_session")
def clustered_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the last session by name, from the row groups that may hold it."""
    table = clustered_events(spark, sf_dir)
    last = table.agg(F.max(SESSION)).first()[0]
    return clustered.events_of(table, SESSION, [last]).select(*staging.STAGED_COLUMNS)


# --- surrogate keys -------------------------------------------------------------------------------

_ENCODED: dict[tuple[str, str], tuple[Warehouse, dict[str, DataFrame]]] = {}


def encoded(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, dict[str, DataFrame]]:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _ENCODED:
        _ENCODED[key] = with_surrogates(of_driver_tables(spark, sf_dir))
    return _ENCODED[key]


def on_numbers(mart: str, column: str) -> Query:
    """A mart built with 8-byte keys, its key as text again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        house, dictionaries = encoded(spark, sf_dir)
        return surrogates.decode(house[mart], column, dictionaries[column])

    return run


QUERIES["numbered_fct_session"] = on_numbers("fct_session", SESSION)
QUERIES["numbered_fct_product_performance"] = on_numbers("fct_product_performance", surrogates.SKU)
QUERIES["numbered_ml_cart_sessions"] = on_numbers("ml_cart_sessions", SESSION)


@query("session_dictionary")
def session_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir)[1][SESSION]


# --- bucketed session tables ------------------------------------------------------------------------

BUCKETS = 16


def on_buckets(mart: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        warehouse = of_driver_tables(spark, sf_dir)
        tables = session_tables(warehouse, own_folder(spark, "bucketed"), BUCKETS)
        return session_marts(tables, warehouse["dim_product"])[mart]

    return run


QUERIES["bucketed_fct_session"] = on_buckets("fct_session")
QUERIES["bucketed_ml_cart_sessions"] = on_buckets("ml_cart_sessions")

on_tables("session_cells", lambda table: table, "session_cells")
on_tables("session_medians", lambda table: table, "session_medians")

# --- skew -----------------------------------------------------------------------------------------


@query("heavy_keys")
def heavy_keys_of_the_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, SKUs and pages with more than a thousandth of all rows of the log, from one sketch pass."""
    raw = of_driver_tables(spark, sf_dir)["raw_browsing"]
    keys = {"session": [SESSION], "sku": ["product_sku_hash"], "page": ["hashed_url"]}
    found = heavy_keys(raw, keys, raw.count() // 1000)
    named = [raw.select(F.lit(k).alias("name"), F.col(v[0]).alias("key")).filter("key is not null") for k, v in keys.items()]
    shown = reduce(DataFrame.unionByName, named).withColumn("hash", F.xxhash64("key"))
    # Few rows: at most a thousand keys of each kind.
    return found.join(shown.distinct(), ["name", "hash"]).select("name", "key", "rows")


# --- joins ----------------------------------------------------------------------------------------


def left_dimension(staged: DataFrame, dimension: DataFrame) -> DataFrame:
    """Events by the price tier of their SKU; counted by SKU first, so a hot SKU is a few rows when it is joined."""
    sku = ["product_sku_hash"]
    counted = staged.groupBy(*sku, "funnel_stage").agg(F.count(F.lit(1)).alias("n"))
    found = counted.join(dimension.select(*sku, "price_tier"), sku, "left")
    return found.groupBy("price_tier", "funnel_stage").agg(F.sum("n").alias("events"))


def with_activity(dimension: DataFrame, products: DataFrame) -> DataFrame:
    kept = dimension.join(products.select("product_sku_hash"), "product_sku_hash", "left_semi")
    return kept.select("product_sku_hash", "price_tier")


def without_catalog(staged: DataFrame, catalog: DataFrame) -> DataFrame:
    browsed = staged.filter(F.col("product_sku_hash").isNotNull()).select("product_sku_hash").distinct()
    return browsed.join(catalog.select("product_sku_hash"), "product_sku_hash", "left_anti")


on_tables("join_left_dim", left_dimension, "stg_browsing", "dim_product")
on_tables("semi_join", with_activity, "dim_product", "fct_product_performance")
on_tables("anti_join_orphans", without_catalog, "stg_browsing", "raw_catalog")

# --- reports ----------------------------------------------------------------------------------------

for _group in ("data_quality", "funnel", "entry", "search", "product"):
    for _name, (_operator, _tables) in REPORTS[_group].items():
        on_tables(_name, _operator, *_tables)
QUERIES["category_performance_view"] = QUERIES["v_category_performance"]

# --- modelling --------------------------------------------------------------------------------------


def scored_carts(carts: DataFrame) -> DataFrame:
    """A fixed score with many ties over all carts, so that the metrics have an exact answer."""
    mix = (
        F.col("pre_n_events") * 37 + F.col("hour_of_day") * 11 + F.col("category_depth") * 5 + F.col("pre_n_searches") * 3
    )
    return carts.select(F.col("purchased").alias("label"), ((mix % 101).cast("double") / 101.0).alias("score"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


on_tables("category_pseudonym", lambda t: model.category_pseudonym(t).select("category", "carts"), "ml_cart_sessions")
on_tables(
    "temporal_split",
    lambda t: model.temporal_split(t.select(SESSION, "add_ts", "purchased")),
    "ml_cart_sessions",
)


def scaled_features(carts: DataFrame) -> DataFrame:
    split = model.temporal_split(carts.select(SESSION, "add_ts", *model.NUMERIC))
    statistics = model.numeric_statistics(split.filter("is_train"), model.NUMERIC)
    scaled = model.impute_scale(split, statistics, model.NUMERIC)
    # Adding zero turns a negative zero into zero.
    return scaled.select(SESSION, *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in model.NUMERIC])


def encoded_levels(carts: DataFrame) -> DataFrame:
    split = model.temporal_split(carts.select(SESSION, "add_ts", model.CATEGORY))
    levels = model.category_levels(split.filter("is_train"))
    encoded = model.encode_category(split, levels)
    return encoded.groupBy("level", "level_index", "is_train").agg(F.count(F.lit(1)).alias("carts"))


on_tables("impute_scale", scaled_features, "ml_cart_sessions")
on_tables("encode_category", encoded_levels, "ml_cart_sessions")
on_tables(
    "baseline_score",
    lambda t: rounded(
        metrics.evaluate(model.baseline_scores(t), "baseline").drop("model"),
        "base_rate", "roc_auc", "pr_auc", "pr_lift", "brier", "prec_top10", "lift_top10", "prec_top20", "lift_top20",
    ),
    "ml_cart_sessions",
)
on_tables("roc_auc", lambda t: rounded(metrics.roc_auc(scored_carts(t)), "roc_auc"), "ml_cart_sessions")
on_tables(
    "average_precision",
    lambda t: rounded(metrics.average_precision(scored_carts(t)), "pr_auc"),
    "ml_cart_sessions",
)
on_tables("brier", lambda t: rounded(metrics.brier(scored_carts(t)), "brier"), "ml_cart_sessions")
on_tables(
    "lift_at_k",
    lambda t: rounded(metrics.lift_at_k(scored_carts(t)), "base_rate", "precision", "lift"),
    "ml_cart_sessions",
)
on_tables("roc_curve", lambda t: metrics.roc_curve(scored_carts(t)), "ml_cart_sessions")
on_tables("pr_curve", lambda t: metrics.pr_curve(scored_carts(t)), "ml_cart_sessions")


for _name, (_operator, _tables) in REPORTS["purchase_intent"].items():
    if _name != "baseline":  # registered as baseline_score
        on_tables(_name, _operator, *_tables)

on_tables("check_logistic", model.check_logistic, "logistic_scores")
on_tables("check_gbt", model.check_gbt, "boosting_scores")
on_tables("check_leakage", model.check_leakage, "leaky_scores")
on_tables("check_models", comparison.check_models, "model_comparison")


def logistic_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = of_driver_tables(spark, sf_dir)
    return model.logistic_moments(tables["model_rows"], tables.fitted("logistic"))


QUERIES["logistic_moments"] = logistic_moments
on_tables("session_entry", marts.entry_context, "stg_browsing")
