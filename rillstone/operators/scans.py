"""Running sums and order statistics without one task that sees all rows.

``running_sum`` deals rows by range of their order, adds up each part, and shifts every part by the
sum of those before it.  ``order_statistics`` finds the elements at given places by counting rows
in buckets and going on in the bucket that holds the place: a few passes of partial aggregates, no
sort of all rows; only the last ``SMALL`` candidates of a place are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import plan, table
from ..plans.tables import written

PARTS, BUCKETS, SMALL = 32, 1024, 4096


def running_sum(rows: DataFrame, order: list[str], value: str, name: str = "running", parts: int = PARTS) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row in ``order`` (which has to be total; nulls
    first) as ``name``: a window without a key, in parts.  Null values add nothing."""
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_own"))  # a row for each part
    before = sums.select("_part", F.coalesce(F.sum("_own").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return own.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))


def order_statistics(rows: DataFrame, value: str, places: DataFrame, by: list[str] | None = None, buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """``(by..., place, value)``: the element at each ``place`` (from 0) of ``places(by..., place)``
    in rising order of a numeric ``value``; nulls and NaN aren't ranked, a place beyond the
    last element has none."""
    by = by or []
    v = F.col(value).cast("double")
    data = rows.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = data.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    asked = places.select(*by, F.col("place").cast("long").alias("place")).distinct()
    # One row for each place that is asked for; ``skip`` elements lie below ``lo``.
    state = written((asked.join(ends, by) if by else asked.crossJoin(ends)).where((F.col("place") >= 0) & (F.col("place") < F.col("n"))).withColumn("skip", F.lit(0).cast("long")))
    key = [*by, "place"]
    while state.where((F.col("lo") < F.col("hi")) & (F.col("n") > small)).take(1):
        wide = state.where((F.col("lo") < F.col("hi")) & (F.col("n") > small))
        # Places in one range are counted together.
        spans = wide.select(*by, "lo", "hi").distinct()
        near = data.join(F.broadcast(spans), (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))) if not by else data.join(spans, by).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets)).cast("int")
        counts = near.groupBy(*by, "lo", "hi", bucket.alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*by, "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("upto", upto)
        found = wide.join(counts, [*by, "lo", "hi"]).where((F.col("place") - F.col("skip") < F.col("upto")) & (F.col("place") - F.col("skip") >= F.col("upto") - F.col("c")))
        found = found.select(*key, F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("c").alias("n"), (F.col("skip") + F.col("upto") - F.col("c")).alias("skip"))
        rest = state.where((F.col("lo") >= F.col("hi")) | (F.col("n") <= small)).select(*key, "lo", "hi", "n", "skip")
        state = written(rest.unionByName(found))
    done = state.where("lo = hi").select(*key, F.col("lo").alias(value))
    open_ = state.where("lo < hi").select(*key, "lo", "hi", "skip")
    near = (data.join(open_, by) if by else data.join(F.broadcast(open_), (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1 + F.col("skip"))
    return done.unionByName(ranked.where("at = place").select(*key, F.col("_v").alias(value)))


@plan("SELECT event_id, CAST(sum(CAST(round(value * 10000) AS BIGINT)) OVER (ORDER BY ts, event_id) AS BIGINT) AS running FROM events")
def running_total(spark, sf_dir):
    """The sum of all values up to each event, in order of time (in ten-thousandths, so exact)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 10_000).cast("long").alias("v"))
    return running_sum(events, ["ts", "event_id"], "v").select("event_id", "running")


_PRICES = """WITH r AS (SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT flag, CAST(pos AS BIGINT) AS place, v AS price FROM r WHERE pos IN (n // 2, n // 10, n - 1)"""


@plan(_PRICES)
def price_ranks(spark, sf_dir):
    """Of each return flag the upper median, the first tenth and the greatest price."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    n = F.col("n")
    places = lines.groupBy("flag").agg(F.count("*").alias("n")).select("flag", F.explode(F.array(F.floor(n / 2), F.floor(n / 10), n - 1)).alias("place"))
    return order_statistics(lines, "price", places, ["flag"])


@plan("SELECT CAST(pos AS BIGINT) AS place, v AS price FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS pos, count(*) OVER () AS n FROM lineitem) x WHERE pos = n // 2")
def price_median(spark, sf_dir):
    """The upper median of all prices."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"))
    return order_statistics(lines, "price", lines.agg(F.floor(F.count("*") / 2).alias("place")))
