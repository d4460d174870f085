"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import catalogue

SF = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(_plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    assert got == want
