"""Every registered query against its SQL twin, on the smallest tables."""

import datetime
import decimal
import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from opsloom.plans import catalog
from opsloom.shipping import ship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "NaN" if math.isnan(v) else f"{float(v):.6g}" if abs(v) > 1e-9 else "0"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


def answer(spark, name):
    """(columns, rows) of a query."""
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    return columns, sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def answers(spark, request):
    """What the selected queries give, several of them at a time."""
    ship(spark)
    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "function", None) is test_query]
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(answer, spark, name) for name in names}


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(answers, con, name):
    columns, rows = answers[name].result()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    at = [list(want.columns).index(c) for c in columns]
    assert len(want.columns) == len(columns)
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
