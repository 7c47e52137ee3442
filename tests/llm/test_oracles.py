"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from kvlake.llm import oracles, queries
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
