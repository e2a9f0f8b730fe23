"""Every query against DuckDB on the same tables, values and all."""

import datetime
import decimal
import glob
import math
import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [r.asDict(recursive=True) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: repr(sorted((k, norm(v)) for k, v in r.items()))
    a, b = sorted(map(key, got)), sorted(map(key, want))
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)


def test_queries_without_sql_run(spark):
    for name, query in entry.queries().items():
        if name not in entry.oracle_sql() and not name.startswith(("op", "pipeline")):
            assert query(spark, SF).count() >= 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_glyph_lines_takes_every_order(spark):
    pages = entry.queries()["glyph_lines"](spark, SF).select("page").distinct().count()
    assert pages == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
