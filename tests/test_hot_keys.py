"""Hot keys take other plans; the results must not differ."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import features, product, quality, staging
from wayfare.operators.ordered import (
    heavy_keys,
    hot_keys,
    join_unique,
    number_rows,
    number_sliced,
    previous_sliced,
    quantiles,
    running_totals,
)
from wayfare.plans.warehouse import Warehouse, of_driver_tables

RAW = (
    "file_row_idx long, session_id_hash string, event_type string, product_action string, "
    "product_sku_hash string, server_timestamp_epoch_ms long, hashed_url string"
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One session holds a third of all rows, half of them in one millisecond; copies and gaps included."""
    rng = random.Random(7)
    events = []
    for i in range(1800):
        hot = i % 3 == 0
        session = "bot" if hot else f"s{rng.randrange(150)}"
        action = rng.choice(["detail", "add", "remove", "purchase", None])
        moment = 1_700_000_000_000 if hot and rng.random() < 0.5 else 1_700_000_000_000 + rng.randrange(400) * 60_000
        events.append(
            (
                session,
                "pageview" if action is None else "event_product",
                action,
                None if action is None else f"k{rng.randrange(25)}",
                moment,
                rng.choice([None, "u1", "u2", "u3"]),
            )
        )
    events += rng.choices(events, k=200)
    events.append((None, "pageview", None, None, 1_700_000_000_000, "u1"))
    events.append(("s1", "pageview", None, None, None, "u1"))
    rng.shuffle(events)
    return spark.createDataFrame([(i, *e) for i, e in enumerate(events)], RAW).repartition(6)


@pytest.fixture(scope="module")
def searches(spark):
    rng = random.Random(8)
    made = []
    for i in range(600):
        session = "bot" if i % 3 == 0 else f"s{rng.randrange(200)}"
        shown = [f"k{rng.randrange(25)}" for _ in range(rng.randrange(6))] or None
        clicked = ([rng.choice(shown)] if shown and rng.random() < 0.5 else []) + (["gone"] if rng.random() < 0.1 else [])
        made.append((i, session, 1_700_000_000_000 + rng.randrange(400) * 60_000, shown, clicked or None))
    schema = (
        "file_row_idx long, session_id_hash string, server_timestamp_epoch_ms long, "
        "product_skus array<string>, clicked_skus array<string>"
    )
    return spark.createDataFrame(made, schema)


@pytest.mark.parametrize("tracked", [16, 64, 65_536])
@pytest.mark.parametrize("threshold", [1, 7, 60, 700, 100_000])
def test_heavy_keys_are_exact_with_every_threshold(spark, tracked, threshold):
    """A few heavy keys, a long tail and a key with a third of the rows; small sketches must go on in parts."""
    rng = random.Random(tracked + threshold)
    made = []
    for i in range(6000):
        a = "hot" if i % 3 == 0 else f"k{min(int(rng.paretovariate(0.7)), 900)}"
        made.append((a, None if i % 5 == 0 else rng.randrange(40), i % 2))
    table = spark.createDataFrame(made, "a string, b int, c int").repartition(7)
    keys = {"one": ["a"], "two": ["b", "c"]}
    found = heavy_keys(table, keys, threshold, tracked)
    want = None
    for name, columns in keys.items():
        counted = table.groupBy(F.xxhash64(*columns).alias("hash")).agg(F.count("*").alias("rows"))
        part = counted.filter(F.col("rows") > threshold).select(F.lit(name).alias("name"), "hash", "rows")
        want = part if want is None else want.unionByName(part)
    assert rows(found) == rows(want)


def test_one_scan_without_heavy_keys(spark, skewed):
    """No candidates, no recount: the sketch is the only job, and its result names no key."""
    assert heavy_keys(skewed, {"session": ["session_id_hash"], "sku": ["product_sku_hash"]}, 5_000).isEmpty()
    assert heavy_keys(skewed.limit(0), {"session": ["session_id_hash"]}, 0).isEmpty()


@pytest.mark.parametrize("hot_rows,slices", [(100, 7), (5, 3), (1, 11)])
def test_staging(skewed, hot_rows, slices):
    plain = staging.stage_browsing(skewed)
    split = staging.stage_browsing(skewed, hot_rows, slices)
    assert rows(split) == rows(plain)


def test_two_stage_dedup(skewed):
    events = staging.usable_events(skewed)
    flood = events.limit(1).crossJoin(skewed.sparkSession.range(300)).withColumn("file_row_idx", F.col("id") + 9000)
    events = events.unionByName(flood.drop("id"))
    plain = rows(staging.dedup_events(events))
    assert rows(staging.dedup_events_by_fingerprint(events)) == plain


def test_two_stage_dedup_with_colliding_fingerprints(skewed, monkeypatch):
    """A fingerprint of few values: most groups hold several events and go on to the second stage."""
    events = staging.usable_events(skewed)
    monkeypatch.setattr(staging.c, "fingerprint", lambda columns: F.pmod(F.xxhash64(*columns), F.lit(700)))
    assert rows(staging.dedup_events_by_fingerprint(events)) == rows(staging.dedup_events(events))


@pytest.mark.parametrize("hot_rows", [100, 5])
def test_cart_features(skewed, searches, hot_rows):
    catalog = skewed.sparkSession.createDataFrame(
        [(f"k{i}", "a/b", ["a", "b"], "a", "b", None, 2, float(i % 10 + 1)) for i in range(0, 25, 2)],
        "product_sku_hash string, category_hash string, category_path array<string>, category_lvl1 string, "
        "category_lvl2 string, category_lvl3 string, category_depth long, price_bucket double",
    )
    raw = {"raw_browsing": lambda: skewed, "raw_search": lambda: searches, "raw_catalog": lambda: catalog}
    plain, split = Warehouse(raw), Warehouse(raw, hot_rows=hot_rows, slices=5)
    for name in ("fct_session", "fct_product_performance", "ml_cart_sessions"):
        assert rows(split[name]) == rows(plain[name]), name
    assert plain["ml_cart_sessions"].filter("pre_n_searches > 0").count() > 10


def test_features_equal_the_join_form(skewed):
    """The aggregation with an anchor column against the join back to the events."""
    staged = staging.stage_browsing(skewed)
    fast = features.truncated_features(staged)
    anchor = features.first_add(staged)
    before = staged.join(anchor, "session_id_hash").filter("event_seq <= add_seq")
    detail = F.col("funnel_stage") == "product_detail"
    slow = before.groupBy("session_id_hash").agg(
        F.count(F.lit(1)).alias("pre_n_events"),
        F.count_distinct(F.when(detail, F.col("product_sku_hash"))).alias("pre_n_skus_viewed"),
        F.count_distinct("hashed_url").alias("pre_n_unique_pages"),
        F.max((detail & (F.col("product_sku_hash") == F.col("added_sku"))).cast("int")).alias("seen"),
    )
    both = fast.join(slow.withColumnsRenamed({n: f"s_{n}" for n in slow.columns if n.startswith("pre")}), "session_id_hash")
    same = [F.col(n) == F.col(f"s_{n}") for n in ("pre_n_events", "pre_n_skus_viewed", "pre_n_unique_pages")]
    same.append(F.col("pre_viewed_added_sku") == F.coalesce("seen", F.lit(0)))
    condition = same[0] & same[1] & same[2] & same[3]
    assert both.count() == fast.count() == slow.count() > 50
    assert both.filter(~condition).count() == 0


@pytest.mark.parametrize("hot_rows", [100, 1])
def test_session_profile(skewed, hot_rows):
    assert rows(quality.session_profile(skewed, hot_rows, 6)) == rows(quality.session_profile(skewed))


def test_numbering_and_previous_value(skewed):
    events = skewed.select("session_id_hash", "server_timestamp_epoch_ms", "file_row_idx")
    key, order = ["session_id_hash"], [F.col("server_timestamp_epoch_ms"), F.col("file_row_idx")]
    hot = hot_keys(events, key, 10)
    assert rows(number_rows(events, key, order, "n", hot, 6)) == rows(number_rows(events, key, order, "n", None))
    value = "server_timestamp_epoch_ms"
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    assert rows(previous_sliced(events, key, order, value, "p", 6)) == rows(events.withColumn("p", before))


def test_global_numbering_is_dense(skewed):
    numbered = number_sliced(skewed, [], [F.col("file_row_idx").desc()], "n", 9)
    assert numbered.filter(F.col("n") + F.col("file_row_idx") != skewed.count()).count() == 0


def test_running_totals(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("v"))
    run = running_totals(table, ["g"], [F.col("id").desc()], {"v": "upto"}, 8)
    total, want = {}, {}
    for i in reversed(range(1000)):
        total[i % 3] = total.get(i % 3, 0) + i % 7
        want[i] = total[i % 3]
    found = {r["id"]: (r["upto"], r["upto_total"]) for r in run.collect()}
    assert found == {i: (want[i], total[i % 3]) for i in range(1000)}


@pytest.mark.parametrize("slices", [1, 2, 7])
def test_quantiles_equal_percentile(spark, slices):
    table = spark.range(0, 999, 1, 5).select((F.col("id") % 4).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    marks = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    want = table.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in marks.items()])
    found = quantiles(table, "v", marks, by=["g"], slices=slices)
    for w, f in zip(want.orderBy("g").collect(), found.orderBy("g").collect()):
        assert w.asDict() == pytest.approx(f.asDict())


def test_quantiles_of_nothing(spark):
    empty = spark.range(0).select(F.col("id").alias("v"))
    assert quantiles(empty, "v", {"m": 0.5}).first()["m"] is None


def test_join_on_hot_and_null_keys(spark):
    big = spark.range(300).select(F.when(F.col("id") % 3 != 0, F.col("id") % 20).alias("k"), "id")
    small = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = big.join(small, "k", "left")
    for threshold in (0, 12, 50):
        hot = hot_keys(big, ["k"], threshold)
        assert rows(join_unique(big, small, ["k"], "left", hot)) == rows(plain)


def test_no_hot_key_keeps_the_ordinary_plan(skewed):
    assert hot_keys(skewed, ["session_id_hash"]) is None


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    warehouse = of_driver_tables(spark, sf_dir)
    raw = warehouse["raw_browsing"]
    first = rows(staging.stage_browsing(raw))
    assert rows(staging.stage_browsing(raw.repartition(13, F.rand(1)))) == first


def test_concentration_equals_the_row_form(spark):
    """Blocks of equal views against a running sum over single SKUs."""
    table = spark.range(2900).select(
        F.col("id").cast("string").alias("product_sku_hash"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("sessions_viewed")
    )
    views = sorted((r["sessions_viewed"] for r in table.collect()), reverse=True)
    found = product.demand_concentration(table, 4).first()
    for name, part in (("top_1_pct", 29), ("top_10_pct", 290), ("top_20_pct", 580)):
        assert found[name] == pytest.approx(100.0 * sum(views[:part]) / sum(views))
