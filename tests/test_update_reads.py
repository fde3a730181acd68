"""An update joins the old raw rows once: staging reads its input several times, so it gets written rows, not the join."""

from __future__ import annotations

from wayfare.operators import incremental, staging

RAW = (
    "file_row_idx long, session_id_hash string, event_type string, product_action string, product_sku_hash string, "
    "server_timestamp_epoch_ms long, hashed_url string"
)
ASKED = "file_row_idx long, session_id_hash string, server_timestamp_epoch_ms long, product_skus array<string>, clicked_skus array<string>"


def test_staging_of_touched_sessions_reads_written_rows(spark, monkeypatch):
    old = spark.createDataFrame([(0, "s", "pageview", None, None, 5, "u"), (1, "t", "pageview", None, None, 6, "u")], RAW)
    new = spark.createDataFrame([(2, "s", "event_product", "add", "k", 9, "u")], RAW)
    asked = spark.createDataFrame([], ASKED)
    kept = {"stg_browsing": staging.stage_browsing(old), "stg_search": staging.stage_search(asked)}
    given, stage = [], staging.stage_browsing

    def watched(raw, *more):
        given.append(raw)
        return stage(raw, *more)

    monkeypatch.setattr(staging, "stage_browsing", watched)
    moved = incremental.change(kept, old, new, asked)
    assert sorted(r["file_row_idx"] for r in given[0].collect()) == [0, 2]
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["session_id_hash"], r["event_seq"]) for r in moved.after.collect()) == [("s", 1), ("s", 2)]
