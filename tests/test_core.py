"""Every query against its SQL twin on the smallest tables, and the corners they lack."""

import os

import duckdb
import pandas as pd
import pytest

from rillstone import catalog
from rillstone.functions import text as t
from rillstone.operators.ingest import chunked
from rillstone.plans.dialect import SPARK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    return float(v) if not str(type(v)).count("bool") else bool(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_twin(spark, con, name):
    mine, twin = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(mine.columns) == sorted(twin.columns)
    rows = lambda df: sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(mine) == rows(twin)


def words(spark, text):
    spark.createDataFrame([(0, text)], "k int, text string").createOrReplaceTempView("one")
    return [r.term for r in spark.sql(t.tokens(SPARK, "one", "k")).collect()]


def test_tokens(spark):
    assert words(spark, "ScrollView scroll view") == ["scroll", "view", "scroll", "view"]
    assert len(set(words(spark, "кольца кольцо"))) == 1
    assert words(spark, "the and of и на") == []
    assert words(spark, "x 7 é") == ["7"]


def test_chunker_keeps_fences_and_paths(spark):
    doc = "# Top\nintro text\n\n- a bullet line\n```\ncode\n\n# not a heading\n```\n- second bullet\n## Sub\n| a | b |\n| c | d |\nafter the table"
    spark.createDataFrame([(1, i, x) for i, x in enumerate(doc.split("\n"))], "doc int, pos int, line string").createOrReplaceTempView("src")
    got = [(r.n, r.heading, r.text) for r in spark.sql(f"WITH {chunked(SPARK, 'src', 5)} SELECT * FROM chunks ORDER BY n").collect()]
    assert [h for _, h, _ in got] == ["Top", "Top", "Top", "Top > Sub", "Top > Sub"]
    assert got[1][2].startswith("- a bullet") and "# not a heading" in got[1][2]
    assert got[3][2] == "| a | b |\n| c | d |"
