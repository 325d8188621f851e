"""Queries against their SQL, on the smallest shared tables."""

import os
from collections import Counter

import duckdb
import pytest

from rillstone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '2GB'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    twin = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in twin.description]
    mine = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert Counter(map(tuple, mine)) == Counter(twin.fetchall())
