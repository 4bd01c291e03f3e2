import duckdb
import pytest

from folioquarry.llm import queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = q.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in got.select(*names).collect()), key=str)
