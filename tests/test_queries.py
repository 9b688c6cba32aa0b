"""Every registered query with SQL against DuckDB on the same tables, and the contract of the entry module."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cellspan.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(rows):
    key = lambda r: tuple((v is None, str(type(v)) if v is None else (round(v, 4) if isinstance(v, float) else v)) for v in r)
    return sorted(rows, key=lambda r: [str(x) for x in key(r)])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = canonical([tuple(r) for r in df.select(*cols).collect()])
    theirs = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})").fetchall()
    theirs = canonical([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in theirs])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, (int, float)):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4), (a, b)
            else:
                assert x == y, (a, b)


def test_entry_has_rows_and_sql_names_known_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
