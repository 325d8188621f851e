"""Registering texts deals no shingle out by a shuffle, and the nearest set is that of a plain loop."""

import random

import numpy as np
from pyspark.sql import functions as F

from rillstone.functions import spans
from rillstone.operators.registry import BUCKETS, LIKE, DocumentRegistry, text_elements


def test_shingles_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    made, seen = DocumentRegistry(spark, str(tmp_path)), []
    monkeypatch.setattr(made.elements, "commit", lambda slices, *a, **k: seen.extend(slices))
    made.register(spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p")], "owner long, text string"), 0)
    kinds = [{r.kind for r in rows.select("kind").distinct().collect()} for rows in seen]
    assert sorted(map(sorted, kinds)) == [["opening", "sentence"], ["shingle"]]
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in seen]
    assert all("Window" not in p for p in plans) and "Exchange" not in plans[kinds.index({"shingle"})]


def test_hashes_come_by_folder(spark):
    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", k=40))) for i in range(30)] + [(30, None), (31, "")]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = spans.row_grams(texts, BUCKETS).collect()
    plain = spans.row_shingles(texts).select("id", "n", F.explode("set")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) > 500
    assert (np.diff([r.h % BUCKETS for r in got]) >= 0).all()


def test_nearest_of_copies_and_of_an_owner_met_before(spark, tmp_path):
    rng = random.Random(11)
    stock = [f"w{i}" for i in range(300)]
    base = [rng.choices(stock, k=30) for _ in range(6)]
    texts = []
    for i in range(80):
        words = list(base[i % 6])
        for _ in range(i % 7):
            words[rng.randrange(30)] = rng.choice(stock)
        texts.append((str(i), " ".join(words)))
    new = texts[:8] + [("900", texts[20][1]), ("901", "nothing of this stands anywhere else at all"), ("902", " ".join(base[0] + base[1]))]
    sets = lambda rows: {i: {tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for i, x in rows}
    stored = sets(texts[2:])
    want = {}
    for i, g in sets(new).items():
        best = min(((-len(g & h) / len(g | h), int(o)) for o, h in stored.items() if o != i and len(g & h) >= LIKE * len(g | h)), default=None)
        if best:
            want[i] = (str(best[1]), round(-best[0], 9))
    made = DocumentRegistry(spark, str(tmp_path), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "owner string, text string")
    made.register(frame(texts[2:]), 0)
    grams = made.sized(text_elements(frame(new))).where("kind = 'shingle'")
    got = {r.owner: (r.b.other, round(r.b.j, 9)) for r in made.nearest(grams, LIKE).collect()}
    assert got == want and len(want) > 5
