"""Every registered query against its oracle SQL in DuckDB, on the small tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quire.plans import images, pages, streams, text, work  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES


def plain(value):
    if value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf_small):
    db = duckdb.connect()
    for path in Path(sf_small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, sf_small, name):
    mine, theirs = QUERIES[name](spark, sf_small), duck.execute(ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    got = [tuple(plain(r[c]) for c in columns) for r in mine.collect()]
    want = [tuple(None if v is None or v != v else v for v in r) for r in rows(theirs, columns)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
