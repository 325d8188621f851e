"""Near-duplicate vectors: all pairs of a group within a distance, by cover trees walked two at a time.

Cosine ``least`` of two vectors is a Euclidean distance ``reach`` of their directions.  A
*cover tree* over points of a group has nested levels of halving radii: a node's children lie
within its radius, and no two of them nearer than half of it.  Every point may have a radius
and a weight of its own, for it may stand for many vectors.  ``pairs_of`` walks two trees
together: a pair of nodes farther apart than both covering radii and the reach is dropped,
one that is nearer whatever lies inside is taken as a whole (counts by weight, one edge), and
any other pair is opened, down to single vectors, which are decided by their cosine.

On Spark: equal vectors of a group are one point with a weight.  A bounded sample of each
group (``SAMPLE`` points of lowest hash) makes a cover tree, whose nodes of half the reach are
*hubs*; points around a hub become one point with its radius, so a crowd of near copies is one
point, however large.  Points are dealt to the top nodes of the sample's tree (``cells``, as
many as the group's size asks for) and visit every cell that their reach touches, by its
covering radius; cells are cut into stripes of ``STRIPE`` points, and a task holds the tree of
one stripe and walks it with the visitors in batches.  Pairs of hubs and others too near to drop
and too far to take are settled by the hubs' members, in the same way.  Nothing that grows is
broadcast or gathered in one task; the sample decides only what is cheap, never what is found.

Edge cases: null or zero vectors, null or non-finite components and null labels link with
nothing (0 links, a component of their own, kept); so do vectors of unlike length, with each
other; repeated rows are vectors of their own; a null id takes no part (its component is null
and it isn't kept); equal vectors link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled, components, give_back

LEAST = 0.93
SAMPLE, CELLS, STRIPE, VISITORS = 1024, 64, 4096, 2048
_EPS, _LEAF = 1e-7, 24  # a distance near 0 is only known to some 1e-8


def _reach(least: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * least))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class CoverTree:
    """Nested levels of halving radii over directions ``x`` whose points reach ``radius`` farther."""

    def __init__(self, x: np.ndarray, radius: np.ndarray, weight: np.ndarray, stop: float):
        self.x, self.radius, self.weight = x, radius, weight
        self.centre: list[int] = []  # of each node, a point
        self.cover: list[float] = []  # how far all below it reaches
        self.below: list[np.ndarray] = []  # child nodes
        self.members: list[np.ndarray] = []  # all points below
        self.root = self._node(np.arange(len(x)), 0, 2.0, stop) if len(x) else -1
        self.centres, self.covers = np.array(self.centre, np.int64), np.array(self.cover)
        self.size = np.array([len(m) for m in self.members], np.int64)
        self.first, self.flat = np.cumsum(self.size) - self.size, np.concatenate([*self.members, np.zeros(0, np.int64)])

    def _node(self, points: np.ndarray, centre: int, scale: float, stop: float) -> int:
        """``points[centre]`` covers all ``points`` within ``scale``; children are centres of half the scale."""
        me = len(self.centre)
        distance = _far(self.x[points], self.x[points[centre : centre + 1]])[:, 0]
        self.centre.append(int(points[centre]))
        self.cover.append(float((distance + self.radius[points]).max()))
        self.below.append(np.zeros(0, np.int64))
        self.members.append(points)
        if len(points) == 1 or scale < stop or distance.max() == 0:
            return me
        scale /= 2
        left, near, children = np.ones(len(points), bool), distance, []
        while True:
            own = left & (near <= scale)
            own[centre] = True
            at = np.flatnonzero(own)
            children.append((at, centre))
            left[at] = False
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            centre = int(rest[0])
            near = np.full(len(points), np.inf)
            near[rest] = _far(self.x[points[rest]], self.x[points[centre : centre + 1]])[:, 0]
            if len(children) > _LEAF and len(children) > 0.9 * (len(points) - len(rest)):  # points far from each other: most are children of their own
                block = self._spread(points, rest, scale)
                children += block
                break
        self.below[me] = np.array([self._node(points[at], int(np.flatnonzero(at == c)[0]), scale, stop) for at, c in children])
        return me

    def _spread(self, points, rest, scale):
        """The same choice of centres, in blocks: a point joins the first centre within ``scale``."""
        out, centres = [], np.zeros(0, np.int64)
        groups: dict[int, list[int]] = {}
        for block in np.array_split(rest, max(1, len(rest) // 256)):
            if len(centres):
                d = _far(self.x[points[block]], self.x[points[centres]]) <= scale
                has, first = d.any(axis=1), d.argmax(axis=1)
                for p, f in zip(block[has], centres[first[has]]):
                    groups[int(f)].append(int(p))
                block = block[~has]
            d = _far(self.x[points[block]], self.x[points[block]]) <= scale
            new: list[int] = []
            for i in range(len(block)):
                near = [j for j in new if d[i, j]] if d[i].sum() > 1 else []
                if near:
                    groups[int(block[near[0]])].append(int(block[i]))
                else:
                    new.append(i)
                    groups[int(block[i])] = [int(block[i])]
            centres = np.r_[centres, block[new]]
        for c, own in groups.items():
            out.append((np.array(sorted(own)), c))
        return out

    def nodes_of(self, scale: float) -> list[int]:
        """The topmost nodes that cover no more than ``scale`` (or have no children)."""
        out, open_ = [], [self.root] if self.root >= 0 else []
        while open_:
            n = open_.pop()
            if self.cover[n] <= scale or not len(self.below[n]):
                out.append(n)
            else:
                open_ += self.below[n].tolist()
        return sorted(out)


def pairs_of(a: CoverTree, b: CoverTree, reach: float, exact):
    """Points of ``a`` and ``b`` within ``reach``: ``(links of a, links of b, edges, open pairs)``.

    Links count weights; edges connect what is linked (indexes of a and b); open pairs have a
    radius that leaves them undecided.  ``a is b`` walks each pair of points once.
    """
    same = a is b
    links_a, links_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    edges: list[np.ndarray] = []
    unclear: list[np.ndarray] = []
    stack = [(a.root, b.root)] if a.root >= 0 and b.root >= 0 else []

    def whole(p, q):
        """All of ``p`` with all of ``q``."""
        links_a[p] += b.weight[q].sum()
        links_b[q] += a.weight[p].sum()
        edges.append(np.stack([np.r_[p, np.full(len(q), p[0])], np.r_[np.full(len(p), q[0]), q]], axis=1))

    def single(p, q, upper):
        """Points one by one."""
        for part in np.array_split(p, max(1, len(p) * len(q) >> 22)):
            d = _far(a.x[part], b.x[q])
            wide = a.radius[part][:, None] + b.radius[q][None, :]
            near = d - wide <= reach + _EPS
            if upper:
                near &= part[:, None] < q[None, :]
            i, j = np.nonzero(near)
            decide(part[i], q[j])

    def decide(p, q):
        """Pairs of points, each by itself."""
        d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a.x[p], b.x[q])))
        w = a.radius[p] + b.radius[q]
        near = np.flatnonzero(d - w <= reach + _EPS)
        p, q, d, w = p[near], q[near], d[near], w[near]
        sure = d + w <= reach - _EPS
        sharp = (w == 0) & ~sure
        sure[sharp] = exact(a, p[sharp], b, q[sharp])
        np.add.at(links_a, p[sure], b.weight[q[sure]])
        np.add.at(links_b, q[sure], a.weight[p[sure]])
        edges.append(np.stack([p[sure], q[sure]], axis=1))
        dim = ~sure & (w > 0)
        unclear.append(np.stack([p[dim], q[dim]], axis=1))

    def small(left, right):
        """Many pairs of nodes with few points, all their points at once."""
        for part in np.array_split(np.arange(len(left)), max(1, int((a.size[left] * b.size[right]).sum()) >> 18)):
            n, m = left[part], right[part]
            each = a.size[n] * b.size[m]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            wide = np.repeat(b.size[m], each)
            decide(a.flat[np.repeat(a.first[n], each) + at // wide], b.flat[np.repeat(b.first[m], each) + at % wide])

    while stack:
        n, m = stack.pop()
        if same and n == m:
            own = a.members[n]
            if len(own) == 1:
                continue
            if 2 * a.cover[n] <= reach - _EPS:  # all of a node with each other
                links_a[own] += a.weight[own].sum() - a.weight[own]
                edges.append(np.stack([own[1:], np.full(len(own) - 1, own[0])], axis=1))
                continue
            kids = a.below[n]
            if not len(kids):
                single(own, own, True)
                continue
            left = right = kids
        else:
            if len(a.members[n]) * len(b.members[m]) <= _LEAF * _LEAF or not len(a.below[n]) and not len(b.below[m]):
                single(a.members[n], b.members[m], False)
                continue
            left = a.below[n] if len(a.below[n]) else np.array([n])
            right = b.below[m] if len(b.below[m]) else np.array([m])
        for rows in np.array_split(np.arange(len(left)), max(1, len(left) * len(right) >> 22)):
            d = _far(a.x[a.centres[left[rows]]], b.x[b.centres[right]])
            wide = a.covers[left[rows]][:, None] + b.covers[right][None, :]
            near = d <= wide + reach + _EPS
            if same and n == m:
                near &= rows[:, None] <= np.arange(len(right))[None, :]
            i, j = np.nonzero(near)
            p, q, taken = left[rows[i]], right[j], d[i, j] + wide[i, j] <= reach - _EPS
            alone = (p == q) if same else np.zeros(len(p), bool)
            few = ~alone & (a.size[p] * b.size[q] <= _LEAF * _LEAF)
            small(p[few], q[few])
            for k in np.flatnonzero(~few & ~(alone & (a.size[p] == 1))):
                if taken[k] and not alone[k]:
                    whole(a.members[p[k]], b.members[q[k]])
                else:
                    stack.append((int(p[k]), int(q[k])))
    gather = lambda x: np.concatenate(x) if x else np.zeros((0, 2), np.int64)
    if same:
        return links_a + links_b, links_b * 0, gather(edges), gather(unclear)
    return links_a, links_b, gather(edges), gather(unclear)


def _runs(batches):
    """``(deal, rows)`` for runs of rows with one value of the first column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        at = codes.indices.to_numpy(zero_copy_only=False)
        edge = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
        for i, j in zip(edge[:-1], edge[1:]):
            yield batch.column(0)[int(i)].as_py(), batch.slice(int(i), int(j - i))


def _matrix(column) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.float64).reshape(len(column), -1) if joined else np.zeros((0, 1))


def _scaled(raw: np.ndarray) -> np.ndarray:
    """The same vectors with their largest component near 1 (by powers of two, so exactly)."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _directions(raw: np.ndarray) -> np.ndarray:
    scaled = _scaled(raw)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _tree(raw, radius, weight, reach) -> CoverTree:
    made = CoverTree(_directions(raw), radius, weight, reach / 8)
    made.raw = _scaled(raw)
    return made


def _hubs(sample: DataFrame, reach: float) -> DataFrame:
    """For each group one row: hubs and cell centres of its sample's cover tree."""

    def plan(table: pa.Table) -> pa.Table:
        grp, n = table["grp"][0].as_py(), table["n"][0].as_py()
        raw = np.array(table["x"].to_pylist(), np.float64)
        tree = _tree(raw, np.zeros(len(raw)), np.ones(len(raw), np.int64), reach)
        crowds = [k for k in tree.nodes_of(reach / 2 - _EPS) if len(tree.members[k]) > 1]
        hubs = tree.x[[tree.centre[k] for k in crowds]] if crowds else np.zeros((0, raw.shape[1]))
        want, level = min(CELLS, -(-n // STRIPE)), [tree.root]
        while len(level) < want and any(len(tree.below[k]) for k in level):
            level = [c for k in level for c in (tree.below[k].tolist() or [k])]
        level = sorted(level, key=lambda k: (-len(tree.members[k]), k))[:want]
        return pa.table({"grp": [grp], "n": pa.array([n], pa.int64()), "hubs": pa.array([hubs.tobytes()], pa.binary()), "centres": pa.array([tree.x[[tree.centre[k] for k in level]].tobytes()], pa.binary())})

    return sample.groupBy("grp").applyInArrow(plan, "grp string, n long, hubs binary, centres binary")


def _sliced(points: DataFrame, plans: DataFrame, point_columns: list[str], plan_columns: list[str]) -> DataFrame:
    """Points behind a copy of their group's plan, dealt in slices of at most some 65,536 points."""
    slices = F.ceil(F.col("n") / 65_536).cast("int")
    sized = points.join(plans.select("grp", slices.alias("slices")), "grp")
    moving = sized.select(F.concat_ws("/", "grp", F.pmod(F.hash("fid"), F.col("slices"))).alias("deal"), F.lit(1).alias("kind"), *point_columns, *[F.lit(None).cast(t).alias(c) for c, t in plans.select(*plan_columns).dtypes])
    held = plans.select("*", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    held = held.select(F.concat_ws("/", "grp", "slice").alias("deal"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in points.select(*point_columns).dtypes], *plan_columns)
    return held.unionByName(moving).repartition("deal").sortWithinPartitions("deal", "kind")


def _placed(points: DataFrame, plans: DataFrame, reach: float) -> DataFrame:
    """Each point's hub (-1: none), cell and distances from both; vectors as bytes."""

    def run(batches):
        hubs = centres = None
        for _, rows in _runs(batches):
            if not rows["kind"][0].as_py():
                width = len(rows["centres"][0].as_py()) // 8
                raw = rows["centres"][0].as_py(), rows["hubs"][0].as_py()
                hubs = centres = None
                rows = rows.slice(1)
            if not rows.num_rows:
                continue
            x = np.asarray(rows["x"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows.num_rows, -1)
            if centres is None:
                centres, hubs = (np.frombuffer(b, np.float64).reshape(-1, x.shape[1]) for b in raw)
            u = _directions(x)
            d = _far(u, centres)
            cell = d.argmin(axis=1)
            hub, away = np.full(len(u), -1), np.zeros(len(u))
            if len(hubs):
                h = _far(u, hubs)
                best = h.argmin(axis=1)
                away = h[np.arange(len(u)), best]
                hub = np.where(away <= reach / 2 - _EPS, best, -1)
            columns = [rows["grp"], rows["fid"], rows["w"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(hub.astype(np.int32)), pa.array(away), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(u)), cell])]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "pid", "w", "x", "hub", "away", "cell", "off"])
        give_back()

    return _sliced(points.withColumnRenamed("pid", "fid"), plans, ["grp", "fid", "w", "x"], ["hubs", "centres"]).mapInArrow(run, "grp string, pid long, w long, x binary, hub int, away double, cell int, off double")


def _visits(fat: DataFrame, plans: DataFrame, reach: float) -> DataFrame:
    """Every point at home in its stripe and, once for each pair of stripes, on a visit."""

    def run(batches):
        for _, rows in _runs(batches):
            if not rows["kind"][0].as_py():
                raw, stripes, covers = rows["centres"][0].as_py(), np.array(rows["stripes"][0].as_py()), np.array(rows["covers"][0].as_py())
                rows = rows.slice(1)
            if not rows.num_rows:
                continue
            x = _matrix(rows["x"])
            centres = np.frombuffer(raw, np.float64).reshape(-1, x.shape[1])
            stripes, covers = stripes[: len(centres)], covers[: len(centres)]
            d, radius = _far(_directions(x), centres), rows["radius"].to_numpy(zero_copy_only=False)
            home = rows["cell"].to_numpy(zero_copy_only=False).astype(np.int64)
            own = (rows["spread"].to_numpy(zero_copy_only=False) % stripes[home]).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(stripes)])
            at = first[home] + own
            touch = (d <= covers[None, :] + radius[:, None] + reach + _EPS) & (np.arange(len(stripes))[None, :] >= home[:, None])
            i, stripe = np.nonzero(np.repeat(touch, stripes, axis=1) & (np.arange(first[-1])[None, :] > at[:, None]))
            rest = rows.select(["grp", "fid", "w", "x", "radius"])
            for who, place, kind in ((np.arange(len(x)), at, 0), (i, stripe, 1)):
                for k in range(0, len(who), 16_384):
                    part = rest.take(pa.array(who[k : k + 16_384]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place[k : k + 16_384]), pa.array(np.full(part.num_rows, kind, np.int32))], ["grp", "fid", "w", "x", "radius", "stripe", "visits"])
        give_back()

    columns = ["grp", "fid", "w", "x", "radius", "cell", "spread"]
    made = _sliced(fat.withColumn("spread", F.pmod(F.xxhash64("fid"), F.lit(1 << 30))), plans, columns, ["centres", "stripes", "covers"]).mapInArrow(run, "grp string, fid long, w long, x binary, radius double, stripe long, visits int")
    return made.select(F.concat_ws("/", "grp", "stripe").alias("deal"), "visits", "fid", "w", "x", "radius")


def _walked(dealt: DataFrame, least: float, selves: bool) -> DataFrame:
    """``(kind, a, b)``: 0 a count of links, 1 an edge, 2 a pair that members have to decide."""
    reach = _reach(least)

    def exact(a, i, b, j):
        x, y = a.raw[i], b.raw[j]
        return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= least

    def tree(parts):
        rows = pa.Table.from_batches(parts)
        made = _tree(_matrix(rows["x"]), rows["radius"].to_numpy(), rows["w"].to_numpy(), reach)
        made.ids = rows["fid"].to_numpy()
        return made

    def told(a, b):
        to_a, to_b, edges, open_ = pairs_of(a, b, reach, exact)
        for own, links in ((a, to_a), (b, to_b)):
            at = np.flatnonzero(links)
            yield 0, own.ids[at], links[at]
        yield 1, a.ids[edges[:, 0]], b.ids[edges[:, 1]]
        yield 2, a.ids[open_[:, 0]], b.ids[open_[:, 1]]

    def run(batches):
        def out(found):
            for kind, a, b in found:
                for k in range(0, len(a), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[k : k + 65_536]), kind, np.int32)), pa.array(a[k : k + 65_536]), pa.array(b[k : k + 65_536])], ["kind", "a", "b"])

        def close(held, guests, home):
            """The tree of those at home, once they are all there; guests walk with it."""
            if home is None and held:
                home = tree(held)
                held.clear()
                if selves:
                    yield from out(told(home, home))
            if guests and home is not None:
                yield from out(told(home, tree(guests)))
            guests.clear()
            return home

        deal, held, guests, home = None, [], [], None
        for now, rows in _runs(batches):
            if now != deal:
                home = yield from close(held, guests, home)
                deal, held, guests, home = now, [], [], None
            visits = rows["visits"].to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(visits, 1))
            if split:
                held.append(rows.slice(0, split))
            if split < len(visits):
                guests.append(rows.slice(split))
                if sum(g.num_rows for g in guests) >= VISITORS:
                    home = yield from close(held, guests, home)
        yield from close(held, guests, home)
        give_back()

    return dealt.repartition("deal").sortWithinPartitions("deal", "visits", "fid").mapInArrow(run, "kind int, a long, b long")


def _settled_by_members(open_: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """The pairs of points of ``open_(a, b)``, as :func:`_walked` tells them."""
    sizes = members.groupBy("fid").agg(F.count("*").alias("size"))
    parts = open_.join(sizes.withColumnRenamed("fid", "a"), "a").withColumn("stripes", F.ceil(F.col("size") / STRIPE).cast("int"))
    point = [F.col("pid").alias("fid"), "w", "x", F.lit(0.0).alias("radius")]
    home = parts.join(members.withColumnRenamed("fid", "a"), "a").select(F.concat_ws("/", "a", "b", F.pmod(F.xxhash64("pid"), F.col("stripes"))).alias("deal"), F.lit(0).alias("visits"), *point)
    away = parts.join(members.withColumnRenamed("fid", "b"), "b").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    return _walked(home.unionByName(away.select(F.concat_ws("/", "a", "b", "stripe").alias("deal"), F.lit(1).alias("visits"), *point)), least, False)


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for ``vectors(vec_id, label, embedding)``."""
    reach = _reach(least)
    v = F.col("x")
    fine = F.exists(v, lambda e: e != 0) & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float("inf")) & ~F.isnan(e))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    usable = rows.where("fine").select("vec_id", F.concat_ws("|", "label", F.size("x")).alias("grp"), F.xxhash64("x").alias("key"), "x")
    points = Settled(usable.groupBy("grp", "key", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).withColumn("pid", F.monotonically_increasing_id())).df
    sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64("key", F.lit(7)), "pid")
    sample = points.select("grp", "key", "pid", "x").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)
    plans = Settled(_hubs(sample.join(sizes, "grp").select("grp", "n", "x"), reach)).df
    placed = Settled(_placed(points, plans, reach)).df
    crowd = placed.where("hub >= 0").groupBy("grp", "hub").agg(F.min("pid").alias("fid"), F.sum("w").alias("w"), F.max("away").alias("radius"), F.min_by(F.struct("x", "cell", "off"), "away").alias("c"), F.min("away").alias("least"))
    fat = placed.where("hub < 0").select("grp", F.col("pid").alias("fid"), "w", "x", F.lit(0.0).alias("radius"), "cell", "off")
    # A hub is the member nearest to the sample's node; the others reach no farther than both distances together.
    fat = Settled(fat.unionByName(crowd.select("grp", "fid", "w", "c.x", (F.col("radius") + F.col("least")).alias("radius"), "c.cell", "c.off"))).df
    spots = fat.groupBy("grp", "cell").agg(F.count("*").alias("size"), F.max(F.col("off") + F.col("radius")).alias("cover"))
    spots = spots.groupBy("grp").agg(F.collect_list(F.struct("cell", "size", "cover")).alias("s"))
    field = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(F.transform("s", lambda c: F.struct(c["cell"], c[name]))), i), F.lit(none)))
    stripes = F.transform(field("size", 0), lambda n: F.greatest(F.lit(1), F.ceil(n / STRIPE)).cast("int"))
    visits = plans.join(spots, "grp").select("grp", "n", "centres", stripes.alias("stripes"), field("cover", 0.0).alias("covers"))
    found = Settled(_walked(_visits(fat, visits, reach), least, True)).df
    fid = placed.where("hub >= 0").select("grp", "hub", "pid", "w", "x").join(crowd.select("grp", "hub", "fid"), ["grp", "hub"]).select("pid", "fid", "w", "x")
    members = Settled(fid.unionByName(placed.where("hub < 0").select("pid", F.col("pid").alias("fid"), "w", "x"))).df
    decided = Settled(_settled_by_members(found.where("kind = 2").select("a", "b").distinct(), members, least)).df
    of = members.select("pid", "fid")
    edges = decided.where("kind = 1").join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    roots = components(found.where("kind = 1").select("a", "b").unionByName(edges))
    whole = members.groupBy("fid").agg(F.sum("w").alias("all_w"))
    by_fid = found.where("kind = 0").groupBy(F.col("a").alias("fid")).agg(F.sum("b").alias("more"))
    by_pid = decided.where("kind = 0").groupBy(F.col("a").alias("pid")).agg(F.sum("b").alias("own"))
    each = members.select("pid", "fid").join(whole, "fid").join(by_fid, "fid", "left").join(by_pid, "pid", "left").join(roots.toDF("fid", "root"), "fid", "left")
    each = each.join(points.select("pid", "id"), "pid").select("pid", "id", F.coalesce("root", "fid").alias("root"), (F.col("all_w") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links"))
    each = Settled(each).df
    named = each.join(each.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("pid", "n_links", "component_id")
    linked = usable.join(points.select("grp", "key", "x", "pid"), ["grp", "key", "x"]).join(named, "pid").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def report(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
