import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from folioquarry.plans.registry import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.01"
con = duckdb.connect()
for t in ("customer", "part", "lineitem", "orders", "events", "supplier", "nation"):
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
