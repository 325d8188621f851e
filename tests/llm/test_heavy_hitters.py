"""Heavy hitters against exact counts."""

import json
from collections import Counter

import numpy as np
import pytest

from rillstone.llm import heavy_hitters as hh


def entries(seed=3, n=4000):
    rng = np.random.default_rng(seed)
    rows = []
    for g, keys in enumerate((3, 9, 12, 40, 300, 2000)):
        for k in rng.zipf(1.4, n // (1 + g)) % keys:
            rows.append(("a" if g % 2 else "b", g, f"k{k}", int(rng.integers(0, 5))))
    rows += [("a", 77, f"only{i}", 1) for i in range(9)] + [("a", 78, f"all{i}", 7) for i in range(11)] + [("c", 0, "zero", 0), ("c", 1, "", 2), ("c", 1, "é" * 3000, 2)]
    rows += [("b", None, "k", 1), ("b", 4, None, 1), ("b", 4, "k1", None), (None, 4, "k1", 3)]
    return rows + rows[:50]


def plain(rows):
    w, n = Counter(), Counter()
    for s, g, k, x in rows:
        if g is not None and k is not None and x is not None:
            w[s, g, k] += x
            n[s, g] += 1
    total = Counter()
    for (s, g, _), x in w.items():
        total[s, g] += x
    return {(s, g, k, n[s, g], total[s, g], x) for (s, g, k), x in w.items() if s is not None and 10 * x > total[s, g]}


@pytest.mark.parametrize("flush,slices,columns", [(1 << 20, 1 << 16, 64), (300, 500, 64), (1000, 200, 4)])
def test_heavy(spark, monkeypatch, flush, slices, columns):
    for name, value in (("FLUSH", flush), ("SLICE_ROWS", slices), ("COLUMNS", columns), ("BLOOM_BITS", 1 << 16)):
        monkeypatch.setattr(hh, name, value)
    rows = [r for r in entries() if r[0] is not None]
    got = hh.heavy_hitters(spark.createDataFrame([(*r, 1) for r in rows], "stream string, grp long, item string, w long, total int").repartition(5)).collect()
    assert {(r.stream, r.grp, r.item, r.n_entries, r.total, r.w) for r in got} == plain(rows) and len(got) == len(plain(rows))
    for r in got:
        assert r.low <= r.w <= r.high and r.low <= r.estimate <= r.high and 40 * (r.high - r.low) <= r.total


def test_votes_bound_every_key():
    """Whatever order parts are added up in, a cell's votes bound its candidate and all others."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys, w = rng.integers(0, 6, 200), rng.integers(1, 9, 200)
    for cuts in ([200], [3, 50, 51, 120, 200], list(range(1, 201))):
        parts, start = [], 0
        for stop in cuts:
            size = stop - start
            t = pa.table({"stream": ["s"] * size, "grp": np.zeros(size, np.int64), "cell": np.zeros(size, np.int32), "item": [str(k) for k in keys[start:stop]], "votes": w[start:stop], "total": w[start:stop]})
            parts, start = [*parts, hh._vote(t)], stop
        r = hh._vote(pa.concat_tables(parts).combine_chunks()).to_pylist()[0]
        weigh = {str(k): int(w[keys == k].sum()) for k in range(6)}
        assert r["total"] == w.sum() and r["votes"] <= weigh[r["item"]] <= (r["total"] + r["votes"]) / 2
        assert all(x <= (r["total"] - r["votes"]) / 2 for k, x in weigh.items() if k != r["item"])


def test_misra_gries_errs_by_its_cuts():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = rng.zipf(1.2, 5000) % 400
    parts = [hh._misra_gries(pa.table({"stream": ["s"] * len(p), "grp": np.zeros(len(p), np.int64), "item": [str(k) for k in p], "c": np.ones(len(p), np.int64)})) for p in np.split(keys, [700, 701, 3000])]
    rows = hh._misra_gries(pa.concat_tables(parts).combine_chunks(), again=True).to_pylist()
    lost = sum(r["c"] for r in rows if r["item"] is None)
    held = {r["item"]: r["c"] for r in rows if r["item"] is not None}
    assert len(held) <= hh.COUNTERS and lost * (hh.COUNTERS + 1) <= 5000 - sum(held.values())
    assert all(held.get(str(k), 0) <= n <= held.get(str(k), 0) + lost for k, n in Counter(keys.tolist()).items())


def test_json_entries(spark):
    texts = ['{"device": {"os": "ios"}, "tags": ["a", null, "é", "a"], "items": [{"sku": 5}, {"sku": null}, {"qty": 1}, 3, {"sku": "x"}]}', '{"device": {"os": "ios"}', "[1]", "3", "", None, '{"device": null, "tags": {}, "items": null}', '{"tags": [1, 2.50, true, ["b"]]} x', '{"tags": [1, 2.50, true, ["b"]]}', '{"k": NaN, "tags": ["a"]}', "[" * 5000, '{"t\\u0061gs": ["z"]}']
    got = Counter((r.grp, r.item) for r in hh.of_json(spark.createDataFrame(list(enumerate(texts)), "grp long, props string")).collect())
    assert got == Counter({(0, "os=ios"): 1, (0, "tag=a"): 2, (0, "tag=é"): 1, (0, "sku=5"): 1, (0, "sku=x"): 1, (8, "tag=1"): 1, (8, "tag=2.50"): 1, (8, "tag=true"): 1, (8, 'tag=["b"]'): 1, (11, "tag=z"): 1})


def test_nothing_and_negative(spark):
    assert hh.heavy_hitters(spark.createDataFrame([], "stream string, grp long, item string, w long")).count() == 0
    with pytest.raises(Exception, match="negative"):
        hh.heavy_hitters(spark.createDataFrame([("s", 1, "k", -1)], "stream string, grp long, item string, w long")).count()


def test_query(spark):
    from rillstone.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_heavy_hitters"](spark, sf).collect()
    rows = [("user", (r.ts.date().toordinal() - 719163) if r.ts else None, None if r.client_id is None else str(r.client_id), 1) for r in spark.read.parquet(f"{sf}/clicks.parquet").collect()]
    rows += [("part", r.vendor_id, None if r.item_id is None else str(r.item_id), r.quantity) for r in spark.read.parquet(f"{sf}/sale_lines.parquet").collect()]
    for r in spark.read.parquet(f"{sf}/clicks.parquet").collect():
        try:
            p = json.loads(r.props or "")
        except ValueError:
            continue
        keys = ["os=" + p["device"]["os"]] if p.get("device") else []
        keys += [f"tag={x}" for x in p.get("tags") or [] if x is not None] + [f"sku={x['sku']}" for x in p.get("items") or []]
        rows += [("prop", r.client_id, k, 1) for k in keys]
    assert {(r.stream, r.grp, r.item, r.n_entries, r.total, r.w) for r in got} == plain(rows) and len(got) == len(plain(rows))
