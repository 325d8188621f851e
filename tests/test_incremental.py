"""Stored versions and kept aggregates against full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators.jobs import latest_state, lessons_frequency
from rillstone.plans.registry import ask
from rillstone.sources.incremental import Snapshots, kept_latest, kept_lessons


def diff(old, new, deleted):
    out = {i: "new" for i in new if i not in old} | {i: "changed" for i in new if i in old and sorted(map(repr, new[i])) != sorted(map(repr, old[i]))}
    return out | ({i: "deleted" for i in old if i not in new} if deleted else {})


def versions():
    rng = random.Random(3)
    base = {i: [f"text {i}"] for i in range(-40, 3000)} | {10**12: ["far"], 77: [None], 78: ["a", "a", "b"]}
    new = dict(base)
    for i in (5, 6, 2999, -40):
        new[i] = [f"other {i}"]
    new |= {5000: ["fresh"], 78: ["a", "b", "b"], 77: [""]}
    for i in (100, 10**12):
        del new[i]
    return base, new, rng


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, ts in rows.items() for t in ts] + [(None, "x")], "id long, text string").repartition(3)


def test_versions_differ_by_leaves(spark, tmp_path):
    old, new, _ = versions()
    store = Snapshots(spark, str(tmp_path), 16)
    for name, rows in (("old", old), ("new", new), ("none", {})):
        store.write(frame(spark, rows), name)
    for deleted in (False, True):
        assert {r.id: r.change for r in store.diff("old", "new", deleted).collect()} == diff(old, new, deleted)
    assert store.diff("old", "old").count() == 0 and store.changed_leaves("new", "new").count() == 0
    touched = {i // 16 for i in diff(old, new, True)}
    assert {r.leaf for r in store.changed_leaves("old", "new").collect()} == touched and len(touched) < 12 < store.tree("new", 0).count() / 10
    assert {r.change for r in store.diff("none", "new").collect()} == {"new"} and store.diff("none", "new").count() == len(new)
    assert store.diff("new", "none", True).count() == len(new) and store.diff("none", "none").count() == 0
    read = store.reading("new", store.changed_leaves("old", "new"))
    assert "PartitionFilters: [isnotnull" in (p := read._jdf.queryExecution().executedPlan().toString()) or "leaf" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert read.select(F.input_file_name()).distinct().count() <= len(touched)  # only folders of changed leaves


@pytest.mark.parametrize("make,builder", [(kept_latest, latest_state), (kept_lessons, lessons_frequency)])
def test_kept_aggregates(spark, tmp_path, make, builder):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kept = make(spark, str(tmp_path / "states"))
    for i, (low, high) in enumerate([(0, 300), (300, 301), (301, 10**9)]):
        events.where(f"event_id >= {low} AND event_id < {high}").coalesce(2 if i else 3).write.mode("append").parquet(str(tmp_path / "in"))
        read = spark.read.schema(events.schema).parquet(str(tmp_path / "in"))
        files = len(read.inputFiles())
        n = kept.refresh(read)
        assert n <= 3 and kept.refresh(read) == 0  # the new files only, and once
        whole = ask(spark, builder, events=read)
        if builder is latest_state:
            mine = kept.result().select("user_id", F.col("event_type").alias("state"), "event_id")
        else:
            mine, whole = kept.result().select("lesson", "n"), whole.select("lesson", "n")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, whole.collect())) and files >= n
