from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from wayfare.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    from compare import connect

    return connect(SF)


def rows(df, *drop: str) -> list[str]:
    """The rows of a table as a sorted list, for comparing tables as multisets."""
    kept = df.drop(*drop) if drop else df
    names = sorted(kept.columns)
    return sorted(repr(tuple(r[n] for n in names)) for r in kept.collect())
