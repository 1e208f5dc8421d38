import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_query_is_callable_and_every_sql_has_one():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p2")))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, DATA)
    said = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in said.description]
    assert sorted(columns) == sorted(df.columns)
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    mine = sorted(repr([tidy(r[k]) for k in columns]) for r in df.collect())
    assert mine == sorted(repr([tidy(v) for v in r]) for r in said.fetchall())
