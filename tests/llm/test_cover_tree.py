"""Near-duplicate vectors against all pairs."""

from collections import Counter

import numpy as np
import pytest

from rillstone.llm import cover_tree as ct

SCHEMA = "vec_id long, embedding array<double>, label int, score double"


def plain(rows, least):
    good = [i for i, (v, x, g) in enumerate(rows) if v is not None and g is not None and x and all(e is not None and np.isfinite(e) for e in x) and any(x)]
    up, links = list(range(len(rows))), Counter()

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(good):
        for j in good[:k]:
            a, b = rows[i], rows[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / np.abs(a[1]).max(), np.array(b[1]) / np.abs(b[1]).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[top(i)] = top(j)
    low = {}
    for i in good:
        low[top(i)] = min(low.get(top(i), rows[i][0]), rows[i][0])
    return Counter((v, links[i], c := low.get(top(i), v), v is not None and v == c) for i, (v, _, _) in enumerate(rows))


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label, size in ((0, 250), (1, 60), (2, 1), (3, 90)):
        base = rng.normal(size=(size, 8))
        crowd = base[0] + rng.normal(size=(120 if label == 0 else 10, 8)) * 0.05 * np.abs(base[0]).max()
        loose = base[-1] + rng.normal(size=(60 if label == 0 else 5, 8)) * 0.2 * np.abs(base[-1]).max()
        for x in [*base, *crowd, *loose, *base[:5], base[0] * 3, base[0] * 1e200, base[0] * 1e-200]:
            rows.append((n, x.tolist(), label))
            n += 1
    edge = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0], [-1.0, -2.0]]
    rows += [(n + k, x, 0) for k, x in enumerate(edge)] + [(None, [1.0] * 8, 0), (n + 20, [1.0] * 8, None), (n + 21, [1.0] * 8, None)]
    return rows + rows[:7] + [(3, [5.0] * 8, 0), (3, [-5.0] * 8, 0)]


@pytest.mark.parametrize("least,sample,stripe,cells,visitors", [(0.93, 1024, 4096, 64, 2048), (0.93, 40, 50, 4, 30), (0.93, 2, 64, 64, 2048), (0.5, 64, 60, 8, 64), (0.999, 1024, 200, 64, 64)])
def test_pairs(spark, monkeypatch, least, sample, stripe, cells, visitors):
    for name, value in (("SAMPLE", sample), ("STRIPE", stripe), ("CELLS", cells), ("VISITORS", visitors)):
        monkeypatch.setattr(ct, name, value)
    rows = vectors()
    got = ct.near_duplicates(spark.createDataFrame([(*r, 0.5) for r in rows], SCHEMA).repartition(3), least)
    assert Counter(map(tuple, got.collect())) == plain(rows, least)


def test_trees_walk_every_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 5))
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 5)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius, w = np.zeros(len(x)), rng.integers(1, 5, len(x))
    for reach in (0.05, 0.374, 1.0):
        exact = lambda a, i, b, j: np.linalg.norm(a.x[i] - b.x[j], axis=1) <= reach  # noqa: B023, E731
        a, b = ct.CoverTree(x[:500], radius[:500], w[:500], reach / 8), ct.CoverTree(x[500:], radius[500:], w[500:], reach / 8)
        near = np.linalg.norm(x[:, None] - x[None, :], axis=2) <= reach
        for s, t, m in ((a, b, near[:500, 500:]), (a, a, near[:500, :500] & ~np.eye(500, dtype=bool))):
            to_a, to_b, edges, open_ = ct.pairs_of(s, t, reach, exact)
            assert (to_a == m @ t.weight).all() and not len(open_) and m[edges[:, 0], edges[:, 1]].all()
            assert s is t or (to_b == m.T @ s.weight).all()
        for tree in (a, b):
            for n in range(len(tree.centre)):
                own = tree.members[n]
                assert np.linalg.norm(tree.x[own] - tree.x[tree.centre[n]], axis=1).max() <= tree.cover[n] + 1e-7
                assert not len(tree.below[n]) or sorted(np.concatenate([tree.members[k] for k in tree.below[n]])) == sorted(own)


def test_no_vectors(spark):
    assert ct.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = ct.near_duplicates(spark.createDataFrame([(1, None, 1, 0.0), (2, [0.0], None, 0.0)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
