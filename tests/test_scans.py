"""Running sums and order statistics against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators import scans


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sum(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(50), i, rng.choice([None, *range(-5, 6)])) for i in range(400)] + [(None, 900, 4)]
    got = {(r.a, r.i): r.total for r in scans.running_sum(spark.createDataFrame(rows, "a int, i int, v long").repartition(5), ["a", "i"], "v", "total", parts).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {(a, i): s for (a, i, _), s in zip(ordered, itertools.accumulate(v or 0 for _, _, v in ordered))}
    assert scans.running_sum(spark.createDataFrame([], "a int, v long"), ["a"], "v").count() == 0


def test_parts_are_even(spark):
    """No part holds more than twice the mean, though the times cluster."""
    events = spark.range(20_000).select((F.col("id") * F.col("id") % 1000).alias("ts"), "id", F.lit(1).alias("v"))
    sizes = [r["n"] for r in events.repartitionByRange(16, "ts", "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * 20_000 / 16 and len(sizes) == 16


@pytest.mark.parametrize("buckets,small", [(1024, 4096), (3, 2)])
def test_places(spark, buckets, small):
    rng = random.Random(small)
    make = {"many": [rng.gauss(0, 1e3) for _ in range(300)], "same": [7.5] * 90, "two": [1.0] * 50 + [2.0] * 51, "wide": [10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1]) for _ in range(80)], "one": [3.0], "ends": [-1.7e308, 1.7e308, 0.0]}
    rows = [(g, x) for g, xs in make.items() for x in xs] + [("many", None), ("many", float("nan")), ("none", None)]
    asked = [(g, p) for g, xs in make.items() for p in {0, len(xs) // 2, len(xs) - 1, len(xs), -1, len(xs) // 3}] + [("none", 0), ("other", 0)]
    got = scans.order_statistics(spark.createDataFrame(rows, "g string, x double"), "x", spark.createDataFrame(asked, "g string, place long"), ["g"], buckets, small)
    assert {(r.g, r.place): r.x for r in got.collect()} == {(g, p): sorted(make[g])[p] for g, p in asked if 0 <= p < len(make.get(g, []))}
    whole = sorted(make["many"])
    some = scans.order_statistics(spark.createDataFrame([(x,) for x in whole], "x double"), "x", spark.createDataFrame([(5,), (150,)], "place long"), None, buckets, small)
    assert {r.place: r.x for r in some.collect()} == {5: whole[5], 150: whole[150]}
