"""CSV files to feature table, and the properties that must hold on the way."""

from __future__ import annotations

from collections import defaultdict

import fixture_csv
import journeys
import pytest
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators import quality
from wayfare.plans.warehouse import Warehouse
from wayfare.sources import csv_files

SESSION, TS = "session_id_hash", "server_timestamp_epoch_ms"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    return folder, fixture_csv.write(folder)


@pytest.fixture(scope="module")
def tables(spark, files):
    folder, _ = files
    # Small splits: the browsing file is read in several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        browsing = csv_files.ingest_browsing(spark, str(folder / "browsing_train.csv"))
        search = csv_files.ingest_search(spark, str(folder / "search_train.csv"), with_vectors=True)
        catalog = csv_files.ingest_catalog(spark, str(folder / "sku_to_content.csv"), with_vectors=True)
        warehouse = Warehouse(
            {
                "raw_browsing": lambda: browsing,
                "raw_search": lambda: search["raw_search"],
                "raw_catalog": lambda: catalog["raw_catalog"],
            }
        )
        warehouse.build_all()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return warehouse, search, catalog


@pytest.fixture(scope="module")
def warehouse(tables):
    return tables[0]


@pytest.fixture(scope="module")
def expected(files):
    lines = files[1]
    asked = defaultdict(list)
    for query in journeys.searches(lines["search_train.csv"]):
        asked[query["session"]].append(query)
    return journeys.trails(lines["browsing_train.csv"]), asked, {line[0]: line for line in lines["sku_to_content.csv"]}


def same_rows(table, key, rows: dict) -> None:
    """The table has exactly these rows, and each the expected values in the columns named there."""
    found = {r[key]: r for r in table.collect()}
    assert found.keys() == rows.keys() and table.count() == len(rows)
    for name, row in rows.items():
        assert {c: found[name][c] for c in row} == pytest.approx(row), name


# --- ingest -------------------------------------------------------------------------------------------


def test_file_order_is_captured(warehouse, files):
    found = warehouse["raw_browsing"].orderBy("file_row_idx").collect()
    lines = files[1]["browsing_train.csv"]
    assert [r["file_row_idx"] for r in found] == list(range(len(lines)))
    for row, line in zip(found, lines):
        assert [row[n] if n == TS else (row[n] or "") for n in c.EVENT_COLUMNS] == [
            int(v) if n == TS else v for n, v in zip(c.EVENT_COLUMNS, line)
        ]


def test_several_splits_were_read(spark, files):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        scanned = csv_files.scan_csv(spark, str(files[0] / "browsing_train.csv"), csv_files.BROWSING_CSV)
        assert scanned.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blank_is_null(warehouse, files):
    blanks = [sum(line[k] == "" for line in files[1]["browsing_train.csv"]) for k in (2, 3)]
    raw = warehouse["raw_browsing"]
    assert [raw.filter(F.col(n).isNull()).count() for n in ("product_action", "product_sku_hash")] == blanks
    assert min(blanks) > 0


def test_lists_and_vectors_are_parsed(tables, files):
    _, search, catalog = tables
    line = files[1]["search_train.csv"][4]
    row = search["raw_search"].filter("file_row_idx = 4").first()
    assert row["product_skus"] == eval(line[3]) and row["clicked_skus"] == eval(line[2])  # noqa: S307
    vector = search["raw_search_vectors"].filter("file_row_idx = 4").first()["query_vector"]
    assert vector == [float(v) for v in line[1].strip("[]").split(",")]
    assert catalog["raw_catalog_vectors"].filter("image_vector is not null").first()["image_vector"] == [100.0, -3.5]
    assert catalog["raw_catalog"].filter("category_depth = 2 and category_lvl3 is null").count() > 0


def test_a_bad_value_raises(spark, tmp_path):
    lines = [fixture_csv.HEADERS["browsing_train.csv"], "s,pageview,,,12x,u"]
    (tmp_path / "bad.csv").write_text("\n".join(lines))
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        csv_files.scan_csv(spark, str(tmp_path / "bad.csv"), csv_files.BROWSING_CSV).collect()


def test_a_changed_header_raises(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("session,event_type,product_action,product_sku_hash,t,hashed_url\ns,pageview,,,12,u\n")
    with pytest.raises(Exception, match="header|schema"):
        csv_files.scan_csv(spark, str(tmp_path / "bad.csv"), csv_files.BROWSING_CSV).collect()


def test_quotes_inside_a_field(spark, tmp_path):
    (tmp_path / "q.csv").write_text(fixture_csv.HEADERS["browsing_train.csv"] + '\n"a ""b"" c",pageview,,,5,u\n')
    assert csv_files.scan_csv(spark, str(tmp_path / "q.csv"), csv_files.BROWSING_CSV).first()[0] == 'a "b" c'


# --- whole rows against plain Python -------------------------------------------------------------------


def test_staged_events(warehouse, expected):
    trails, _, _ = expected
    names = [SESSION, "event_seq", "funnel_stage", "product_sku_hash", "hashed_url", TS, "file_row_idx", "raw_row_count"]
    found = sorted(tuple(r) for r in warehouse["stg_browsing"].select(*names).fillna("").collect())
    wanted = [
        (session, e["seq"], e["stage"], e["sku"] or "", e["url"] or "", e["ms"], e["at"], e["copies"])
        for session, events in trails.items()
        for e in events
    ]
    assert found == sorted(wanted)


def test_time_features_are_utc(warehouse):
    for row in warehouse["stg_browsing"].select(TS, "hour_of_day", "day_of_week").collect():
        assert (row["day_of_week"], row["hour_of_day"]) == journeys.weekday_and_hour(row[TS])


def test_lost_rows_are_explained(warehouse, files, expected):
    trails, _, _ = expected
    lines = [tuple(x) for x in files[1]["browsing_train.csv"]]
    distinct, left = len(set(lines)), sum(map(len, trails.values()))
    terms = {r["term"]: r["n_rows"] for r in quality.reconcile(warehouse["raw_browsing"], warehouse["stg_browsing"]).collect()}
    assert terms["redundant copies"] == distinct - len(lines) < 0
    assert terms["pageviews paired with a detail"] == left - distinct < 0
    assert terms["unexplained"] == 0


def test_sessions(warehouse, expected):
    trails, asked, _ = expected
    rows = {name: journeys.session_row(events, asked[name]) for name, events in trails.items()}
    assert len(rows) == fixture_csv.SESSIONS
    assert {r["strict_purchase"] for r in rows.values()} == {True, False, None}
    same_rows(warehouse["fct_session"], SESSION, rows)


def test_carts(warehouse, expected):
    trails, asked, listed = expected
    rows = {name: journeys.cart_row(events, asked[name], listed) for name, events in trails.items()}
    rows = {name: row for name, row in rows.items() if row}
    assert {r["purchased"] for r in rows.values()} == {0, 1}
    same_rows(warehouse["ml_cart_sessions"], SESSION, rows)


def test_features_know_nothing_of_the_whole_session(warehouse):
    """No column of the session table is among the features; the calendar columns are those of the add."""
    carts = set(warehouse["ml_cart_sessions"].columns)
    whole = set(warehouse["fct_session"].columns) - {SESSION, "day_of_week", "hour_of_day"}
    assert not carts & whole


def test_products(warehouse, expected):
    trails, _, listed = expected
    browsed = {e["sku"] for events in trails.values() for e in events if e["sku"]}
    tiers = {"": "(unknown)"} | {f"{k}.0": "low (1-3)" if k <= 3 else "mid (4-7)" if k <= 7 else "high (8-10)" for k in range(1, 11)}
    rows = {
        sku: {"in_catalog": sku in listed, "price_tier": tiers[listed[sku][4] if sku in listed else ""]}
        for sku in browsed | listed.keys()
    }
    assert any(not r["in_catalog"] for r in rows.values()) and len({r["price_tier"] for r in rows.values()}) == 4
    same_rows(warehouse["dim_product"], "product_sku_hash", rows)


def test_searches(warehouse, files):
    rows = {
        at: {"clicks": ",".join(q["valid"]), "n_phantom_clicks": q["phantom"], "is_zero_result": q["empty"]}
        for at, q in enumerate(journeys.searches(files[1]["search_train.csv"]))
    }
    clicks = F.coalesce(F.array_join("valid_clicked_skus", ","), F.lit("")).alias("clicks")
    found = warehouse["stg_search"].select("file_row_idx", clicks, "n_phantom_clicks", "is_zero_result")
    same_rows(found, "file_row_idx", rows)


def test_sessions_that_only_search_are_counted(warehouse, expected):
    trails, asked, _ = expected
    orphans = quality.search_orphans(warehouse["session_profile"], warehouse["raw_search"]).first()[0]
    assert orphans > 0 and asked.keys() - trails.keys()
