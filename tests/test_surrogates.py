"""Dense numbers for long keys: collision-free, stable when texts come in, equal marts, fewer bytes shuffled."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F
from test_hot_keys import skewed  # noqa: F401

from wayfare.operators import marts, staging, surrogates


def names(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [f"{rng.getrandbits(256):064x}" for _ in range(n)]


def test_numbers_are_dense_in_order_and_kept(spark):
    texts = names(500)
    table = spark.createDataFrame([(t,) for t in texts * 3 + [None]], "k string").repartition(5)
    first = surrogates.dictionary(table, slices=7)
    held = {r["text"]: r["id"] for r in first.collect()}
    assert held == {t: i for i, t in enumerate(sorted(texts))}
    more = spark.createDataFrame([(t,) for t in texts[:50] + names(40, 2)], "other string")
    second = {r["text"]: r["id"] for r in surrogates.dictionary(more, known=first, slices=3).collect()}
    assert {t: second[t] for t in held} == held and sorted(second.values()) == list(range(540))
    assert surrogates.dictionary(table.limit(0)).count() == 0


def test_there_and_back(spark):
    table = spark.createDataFrame([(i, t, str(t)[:1]) for i, t in enumerate(names(60) * 2 + [None] * 3)], "i long, k string, c string")
    numbers = surrogates.dictionary(table.select("k"))
    coded = surrogates.encode(table, "k", numbers)
    assert dict(coded.dtypes)["k"] == "bigint" and coded.columns == table.columns
    assert rows(surrogates.decode(coded, "k", numbers)) == rows(table)
    lists = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])], "row long, l array<string>")
    letters = surrogates.dictionary(lists.select(F.explode("l")))
    assert {r["row"]: r["l"] for r in surrogates.encode_list(lists, "l", letters, "row").collect()} == {1: [1, 0, 1], 2: [], 3: None, 4: [2]}


def shuffled_bytes(df) -> int:
    """What the exchanges of a run plan have written, from Spark's own metrics of the plan."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().execute().count()
    seen, total = [plan], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.finalPhysicalPlan())
            continue
        if name.endswith("QueryStageExec"):
            seen.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleBytesWritten").value()
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
    return total


def test_equal_marts_from_fewer_bytes(spark):
    rng = random.Random(3)
    sessions, skus, pages = names(400, 4), names(80, 5), names(60, 6)
    made = []
    for i in range(9000):
        action = rng.choice(["detail", "add", "remove", "purchase", None])
        made.append((i, rng.choice(sessions), "pageview" if action is None else "event_product", action,
                     rng.choice(skus) if action else None, 1_700_000_000_000 + rng.randrange(10_000) * 1000, rng.choice(pages)))
    schema = "file_row_idx long, session_id_hash string, event_type string, product_action string, product_sku_hash string, server_timestamp_epoch_ms long, hashed_url string"
    log = spark.createDataFrame(made, schema).repartition(4)
    coded, dictionaries = log, {}
    for column in ("session_id_hash", "product_sku_hash", "hashed_url"):
        dictionaries[column] = surrogates.dictionary(log.select(column))
        coded = surrogates.encode(coded, column, dictionaries[column])
    from wayfare.session import written

    log, coded = written(log, "log"), written(coded, "coded")
    none = spark.createDataFrame([], "session_id_hash string, n_results long, n_clicks long, n_phantom_clicks long, is_zero_result boolean")
    text = staging.stage_browsing(log)
    number = staging.stage_browsing(coded)
    before, after = shuffled_bytes(text), shuffled_bytes(number)
    print(f"staging: {before} bytes shuffled by text, {after} by number")
    assert 0 < after < before * 0.5
    fact = marts.session_fact(number, none.withColumn("session_id_hash", F.lit(None).cast("bigint")))
    assert rows(surrogates.decode(fact, "session_id_hash", dictionaries["session_id_hash"])) == rows(marts.session_fact(text, none))
