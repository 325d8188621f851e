"""Stateful streams, versioned sinks: late rows, restarts and kills."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillstone.sources.versioned import LatestByKey, VersionedTable
from rillstone.streaming import timers

COLUMNS = "user_id long, ts long, event_id long, event_type string"


class Killed(Exception):
    pass


class Failing:
    """A file system that dies before its n-th change (``left`` counts down)."""

    def __init__(self, fs, left):
        self.fs, self.left = fs, left

    def __getattr__(self, name):
        real = getattr(self.fs, name)
        if name not in ("rename", "delete", "mkdirs", "create"):
            return real

        def call(*args):
            if not self.left:
                raise Killed(name)
            self.left -= 1
            return real(*args)

        return call


def batches():
    rng = random.Random(6)
    return [[(rng.randrange(4), rng.randrange(50), 10 * b + i, f"s{rng.randrange(3)}") for i in range(5)] for b in range(4)]


def newest(rows):
    best = {}
    for r in rows:
        best[r[0]] = max(best.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    return set(best.values())


@pytest.mark.parametrize("where", ["before the part", "after the part", *range(7)])
def test_a_kill_loses_and_repeats_nothing(spark, tmp_path, where):
    """Killed in the third batch (which also folds the parts), then handed in again."""
    made = lambda: LatestByKey(spark, str(tmp_path / "t"), COLUMNS, ["user_id"], ["ts", "event_id"], fold_at=3)
    given = batches()
    for n in (0, 1):
        assert made().put(spark.createDataFrame(given[n], COLUMNS), n)
    dying = made()
    if isinstance(where, int):
        dying.table.fs = Failing(dying.table.fs, where)
    else:
        write = dying.table._write

        def part(rows, at, by):
            if where == "after the part":
                write(rows, at, by)
            raise Killed

        dying.table._write = part
    third = spark.createDataFrame(given[2], COLUMNS)
    try:
        dying.put(third, 2)
        killed = False
    except Killed:
        killed = True
    assert killed == (where not in (6,)) or isinstance(where, int)
    seen = {tuple(r) for r in made().read().collect()}
    assert seen in (newest(sum(given[:2], [])), newest(sum(given[:3], [])))
    made().put(third, 2)
    assert {tuple(r) for r in made().read().collect()} == newest(sum(given[:3], []))
    assert not made().put(third, 2)
    assert made().put(spark.createDataFrame(given[3], COLUMNS), 3)
    assert {tuple(r) for r in made().read().collect()} == newest(sum(given, []))
    made().table.compact(lambda df: df)
    assert len(made().table._names("parts")) == len(made().table.version().parts) and len(made().table._names("versions")) == 1


def test_a_batch_writes_its_own_size(spark, tmp_path):
    kept = LatestByKey(spark, str(tmp_path / "t"), COLUMNS, ["user_id"], ["ts", "event_id"])
    kept.put(spark.range(2000).selectExpr("id AS user_id", "id AS ts", "id AS event_id", "'a' AS event_type"), 0)
    kept.put(spark.createDataFrame([(5, 9999, 1, "b")], COLUMNS), 1)
    last = kept.table.version().parts[-1]
    assert spark.read.parquet(f"{tmp_path}/t/{last}").count() == 1
    assert {r.event_type for r in kept.read().where("user_id = 5").collect()} == {"b"} and kept.read().count() == 2000


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), "a long") for _ in range(2))
    before = one.version()
    two.commit(spark.range(1).toDF("a"), "w", 0)
    one.version = lambda: before
    with pytest.raises(RuntimeError, match="another writer"):
        one.commit(spark.range(1).toDF("a"), "v", 0)
    assert two.read().count() == 1 and VersionedTable(spark, str(tmp_path / "none"), "a long").read().count() == 0


def replies(rows, cap):
    out = Counter()
    for k, i, ms, kind in rows:
        if kind == "message":
            first = min((m for kk, _, m, x in rows if kk == k and x == "reply" and ms <= m <= ms + cap * 1000), default=None)
            out[(k, i, ms, first, first is None)] += 1
    return out


def stuck(rows, check, forget):
    by, out = defaultdict(dict), Counter()
    for k, i, ms, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        by[k][ms // (check * 1000)] = (i, ms, kind)
    for k, sights in by.items():
        mark = None
        for span in sorted(sights):
            i, ms, sign = sights[span]
            if mark and ms - mark[0] > forget * 1000:
                mark = None
            if sign is not None and mark and mark[1] == sign:
                out[(k, i, ms, sign)] += 1
                mark = None
            else:
                mark = None if sign is None else (ms, sign)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, id long, ms long, kind string").withColumn("ts", F.timestamp_millis("ms")).select("key", "id", "ts", "kind")


def streamed(spark, folder, parts, make, schema, restart):
    """Each part is a file; a restart runs the query to the end after every one."""
    out = VersionedTable(spark, f"{folder}/out", schema)
    for rows in parts:
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if restart:
            stream = spark.readStream.schema(table(spark, rows).schema).parquet(f"{folder}/in")
            timers.run_all(make(stream), VersionedTable(spark, f"{folder}/out", schema), f"{folder}/mark")
    if not restart:
        stream = spark.readStream.schema(table(spark, parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        timers.run_all(make(stream), out, f"{folder}/mark")
    return Counter(map(tuple, out.read().collect()))


def history(kinds, n=160, seed=9):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), i, 1_700_000_000_000 + rng.randrange(40_000) * 100, rng.choice(kinds)) for i in range(n)]
    rows += [(0, 900, 1_700_000_500_000, kinds[0]), (0, 901, 1_700_000_500_000, kinds[0])]
    return sorted(rows, key=lambda r: r[2] + rng.randrange(50_000))  # up to 50 s late


CLOSE = [[(-1, 10_000, 1_700_500_000_000, None)]]


@pytest.mark.parametrize("restart", [False, True])
def test_every_message_is_told_of_once(spark, tmp_path, restart):
    rows = history(["message", "reply", "message"])
    parts = [list(p) for p in (rows[:50], rows[50:51], rows[51:120], rows[120:])] + CLOSE
    got = streamed(spark, tmp_path, parts, lambda s: timers.reply_timeouts(s, 240, "1 minute"), "key long, id long, asked long, answered long, timed_out boolean", restart)
    assert got == replies(rows, 240)


def test_two_replies_give_one_row(spark, tmp_path):
    rows = [(1, 1, 1_000_000, "message"), (1, 2, 1_010_000, "reply"), (1, 3, 1_020_000, "reply"), (2, 4, 1_000_000, "message"), (2, 5, 1_241_000, "reply"), (3, 6, 1_000_000, "message"), (3, 7, 1_240_000, "reply")]
    got = streamed(spark, tmp_path, [rows, *CLOSE], timers.reply_timeouts, "key long, id long, asked long, answered long, timed_out boolean", False)
    assert got == Counter([(1, 1, 1_000_000, 1_010_000, False), (2, 4, 1_000_000, None, True), (3, 6, 1_000_000, 1_240_000, False)])


@pytest.mark.parametrize("restart", [False, True])
def test_stuck_stream_is_the_table(spark, tmp_path, restart):
    rows = history(["a", "b", "a", None], 200)
    parts = [rows[:70], rows[70:140], rows[140:]] + CLOSE
    got = streamed(spark, tmp_path, parts, lambda s: timers.stuck(s, 300, 900, "1 minute"), "key long, id long, ms long, sign string", restart)
    assert got == stuck(rows, 300, 900) and got
    assert Counter(map(tuple, timers.stuck_rows(table(spark, rows), 300, 900).collect())) == got


def test_four_equal_sights_are_two_restarts(spark):
    rows = [(1, i, i * 300_000, "x") for i in range(4)] + [(2, i, i * 300_000, s) for i, s in enumerate(["x", None, "x", "y", "y", "y"])]
    got = sorted((r.key, r.id) for r in timers.stuck_rows(table(spark, rows)).collect())
    assert got == [(1, 1), (1, 3), (2, 4)]
    assert list(itertools.chain(stuck(rows, 300, 86_400))) and timers.stuck_rows(table(spark, rows).limit(0)).count() == 0


def test_slices_of_many_tasks(spark):
    """Rows that many tasks write are all in time for the stream."""
    rows = table(spark, [(i % 7, i, 1_700_000_000_000 + i * 60_000, "ab"[i // 9 % 2]) for i in range(900)]).repartition(12)
    got = timers._streamed(spark, rows, timers.stuck, "key long, id long, ms long, sign string")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, timers.stuck_rows(rows).collect()))
