import os

import duckdb
import pytest

from dossier.plans.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(ORACLE_SQL[name])
    order = [expected.columns.index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in order) for r in expected.fetchall())
