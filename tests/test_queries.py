"""Every query with SQL against DuckDB on the same tables."""

import decimal
import math
import numbers

import duckdb
import pandas as pd
import pytest
from siltstone import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(medium):
    # at the size that the expected constants of the policy queries were read from: which columns
    # are unique, and hence keys, depends on the rows
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, numbers.Number | decimal.Decimal):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, medium, duck, name):
    df = queries.ALL[name](spark, medium)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.ALL) - set(queries.ORACLES)))
def test_without_sql(spark, small, name):
    assert queries.ALL[name](spark, small).collect()


def test_entry(spark, small):
    rows = queries.entry(spark, small).collect()
    assert len(rows) == 11 and all(r.n_rows == 6000 for r in rows)
