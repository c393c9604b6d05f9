"""The SQL twins give the rows of their queries, on awkward documents too."""

import os

import duckdb
import pytest

from tallyflow.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("given", ["awkward", SMALL])
def test_same_rows(spark, sf_dir, name, given):
    folder = sf_dir if given == "awkward" else given
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        path = f"{folder}/{table}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    expected = connection.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    expected = sorted(expected.fetchall())
    frame = QUERIES[name](spark, folder)
    assert set(columns) == set(frame.columns)
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == expected
