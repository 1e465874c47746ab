from __future__ import annotations

from datetime import datetime

import pytest

from touchline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("8", app="touchline-tests", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a DataFrame from a DDL schema and row tuples."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows(df, *columns: str) -> list[tuple]:
    """Rows in a fixed order, NULLs first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
