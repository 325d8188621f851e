"""Printed hits round as the SQL's printf does."""

import duckdb

from rillstone.operators.retrieval import printed


def test_scores_halfway_between_two_places(spark):
    scores = [0.125, 0.375, 2.675, 1.005, 12.345, 12.355, 99.995, 999.995, 0.004999, 41.5, 1234567.125] + [k / 1000 for k in range(10005, 10100, 10)]
    rows = [(i, 1, i, s) for i, s in enumerate(scores)] + [(99, 1, 99, None)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, id long, score double")
    texts = spark.createDataFrame([(i, "first\nsecond" if i % 2 else None) for i, *_ in rows], "id long, text string")
    want = {(i, 1, None if s is None else duckdb.execute("SELECT printf('%6.2f', ?::DOUBLE)", [s]).fetchone()[0] + f"  [{i}]  \n        {'first' if i % 2 else ''}") for i, _, _, s in rows}
    assert set(map(tuple, printed(hits, texts).collect())) == want
