"""Every query with SQL equals it on the smallest tables; every other one runs."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cur = db.execute(SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = norm([[r[cols.index(c)] for c in sorted(cols)] for r in cur.fetchall()])
    assert norm([[r[c] for c in sorted(cols)] for r in df.collect()]) == want


#: What has rows only in larger tables.
EMPTY = {"q01_enqueue"}


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not re.match(r"p\d+_", n)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows or name in EMPTY
