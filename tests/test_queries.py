"""Every registered query of the core runs, and agrees with its SQL, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import pytest

from corvina.plans import core_queries, more_queries, quality_queries, text_queries

DATA = Path("/root/testdata/sf0.001")
QUERIES = {**quality_queries.QUERIES, **core_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES}
ORACLE = {**quality_queries.ORACLE, **core_queries.ORACLE, **text_queries.ORACLE, **more_queries.ORACLE}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    heads = list(rel.columns)
    assert sorted(heads) == cols
    want = sorted(tuple(norm(r[heads.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
