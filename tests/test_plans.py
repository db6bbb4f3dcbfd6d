"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REFERENCE = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        raise TypeError("decimals differ between engines")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:19]
    return str(v)


@pytest.mark.parametrize("name", REFERENCE)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    rows = frame.collect()
    if name not in entry.oracle_sql():
        return
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
