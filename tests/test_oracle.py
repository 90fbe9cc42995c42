"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

LLM = ("op", "pipeline")
NAMES = [n for n in entry.queries() if not n.startswith(LLM)]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", [n for n in NAMES if not os.environ.get("ONLY") or n in os.environ["ONLY"].split(",")])
def test_query(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got, "no rows"
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert got, "no rows"
    assert sorted(got, key=str) == sorted(want, key=str)
