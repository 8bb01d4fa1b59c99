import math

import duckdb
import pytest

from pixelfurrow.plans.extended import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    if name in ORACLE_SQL:
        out = duck.sql(ORACLE_SQL[name])
        assert sorted(out.columns) == names
        expected = sorted(([plain(r[out.columns.index(c)]) for c in names] for r in out.fetchall()), key=str)
        assert rows == expected
    else:
        assert rows
