import duckdb
import pytest

from folioscope.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    """All rows and columns, on the smallest tables."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    want = sorted(map(repr, con.fetchall()))
    got = queries.queries()[name](spark, DATA)
    assert set(got.columns) == set(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
