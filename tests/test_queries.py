"""Every registered query of the library against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
#: Without SQL, and run by tests of their own that know their rows.
OWN = {"gr5_ppr_whole", "v19_context", "v20_compress_whole", "g4_table_chunks"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OWN))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert rows
        return
    r = duck.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in cols) for x in rows) == want
