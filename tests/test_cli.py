"""The command line from CSV files to reports and a verified serving copy."""

from __future__ import annotations

import fixture_csv
import pytest

from wayfare.__main__ import main
from wayfare.session import shared_folder
from wayfare.sources.versions import children, current


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    (base / "raw").mkdir()
    fixture_csv.write(base / "raw")
    return base


def test_build_report_load_verify(spark, folders, capsys):
    before = children(spark, f"{shared_folder(spark)}/wayfare")
    raw, house, out, serving = (str(folders / n) for n in ("raw", "warehouse", "reports", "serving"))
    assert main(["build", "--raw", raw, "--warehouse", house, "--only", "catalog"]) == 0
    for _ in range(2):  # a second build replaces the first
        assert main(["build", "--raw", raw, "--warehouse", house, "--with-vectors"]) == 0
    assert f"fct_session: {fixture_csv.SESSIONS} rows" in capsys.readouterr().out
    assert current(spark, f"{house}/raw_search_vectors").count() == 180
    assert current(spark, f"{house}/raw_catalog_vectors").columns == [
        "product_sku_hash", "description_vector", "image_vector",
    ]
    assert main(["report", "--warehouse", house, "--out", out, "--report", "funnel", "product"]) == 0
    assert spark.read.option("header", True).csv(f"{out}/funnel/v_funnel").count() == 8
    assert main(["load", "--warehouse", house, "--serving", serving]) == 0
    assert main(["verify", "--warehouse", house, "--serving", serving]) == 0
    # A copy that has drifted is noticed.
    sessions = current(spark, f"{house}/fct_session").filter("n_adds > 0")
    sessions.write.mode("overwrite").parquet(f"{serving}/fct_session")
    assert main(["verify", "--warehouse", house, "--serving", serving]) == 1
    # Of the runs nothing stays but one version per table.
    assert children(spark, f"{shared_folder(spark)}/wayfare") == before
    assert all(len([x for x in children(spark, f"{house}/{n}") if x.startswith("_version")]) == 1 for n in children(spark, house))
