"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled 1) and texts whose labels aren't looked at (a sample of all
training documents, labelled or not) train a small network
that minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic losses.  The class prior is estimated from the same two samples: it
is at most U(A) / P(A) for every set A, so the least such ratio over the upper
tails of a cross-fitted positive-against-unlabelled score is taken.  Labels of
negatives are not used.

Features of a whole text: frequencies of trigrams of byte classes, shares of
repeated words, trigrams and lines, and means.  Learning uses at most ``POSITIVE``
labelled rows and ``UNLABELLED`` rows (distinct pairs of id and text, lowest hashes; a
threshold leaves a few times that many before anything is sorted).  The network is fitted in
one task and only its weights reach the driver.

Edge cases: a null text counts as empty and is scored like one; rows with null
ids teach nothing; with fewer than two positives or texts every score is 0.5;
repeated rows are kept; a document labelled more than once is positive if any of
its labels is 1; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import binary_rows, fitted, held_out, map_arrow

POSITIVE, UNLABELLED = 5000, 8000
THRESHOLD = 0.7

_c = np.arange(256)
_CLASS = np.select([(_c >= 97) & (_c <= 122), (_c >= 65) & (_c <= 90), (_c >= 48) & (_c <= 57), _c >= 128, _c == 10, (_c == 32) | (_c == 9),
                    np.isin(_c, [ord(x) for x in ".,;:?'\"-()"])], [0, 1, 2, 3, 4, 5, 6], 7).astype(np.int64)
WIDTH = 512 + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text of a run."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    hashes, starts, ends, first = wb.words(data, offsets, wb.SPACED)
    kind = np.concatenate([_CLASS[data], [5, 5]])
    second, third = kind[1:-1].copy(), kind[2:].copy()
    last = offsets[1:][np.diff(offsets) > 0] - 1  # a text's last trigrams end in blanks, whatever text comes next
    second[last] = third[last] = third[np.maximum(last - 1, 0)] = 5
    gram = kind[:-2] * 64 + second * 8 + third
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    mark = np.concatenate([[0], np.cumsum(_CLASS[data] == 7)])
    length = ends - starts
    for r, (a, b, i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            out[r, :512] = np.sqrt(np.bincount(gram[a:b], minlength=512)[:512] / (b - a))
            out[r, 512:514] = (upper[b] - upper[a]) / (b - a), (mark[b] - mark[a]) / (b - a)
        w = hashes[i:j]
        m = j - i
        if m:
            out[r, 514] = (w[1:] == w[:-1]).sum() / m
            out[r, 515] = len(np.unique(w)) / m
            out[r, 516] = len(np.unique(wb.grams(w, 3))) / max(1, m - 2)
            out[r, 517] = length[i:j].mean() / 10
            out[r, 518] = np.log1p(m) / 10
            out[r, 519] = (lines[b] - lines[a]) / m
    return out


def _featured(batch: pa.RecordBatch):
    for at, offsets, data in wb.runs(batch.column(1)):
        x = features(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).slice(at, len(x))], ["positive", "x", "h"])


class Network:
    """One hidden layer; ``risk`` is 'pu' (non-negative) or 'plain' (P against U)."""

    def __init__(self, xp: np.ndarray, xu: np.ndarray, prior: float, risk: str, hidden: int = 24, epochs: int = 30, seed: int = 1):
        rng = np.random.default_rng(seed)
        every = np.concatenate([xp, xu])
        self.middle, self.spread = every.mean(0), every.std(0) + 1e-2
        xp, xu = self._scaled(xp), self._scaled(xu)
        shape = (WIDTH, hidden)
        self.p = [rng.normal(0, 1 / np.sqrt(WIDTH), shape), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(v) for v in self.p], [np.zeros_like(v) for v in self.p], 0
        batches = max(1, len(xu) // 256)
        for _ in range(max(epochs, 25 * epochs // batches)):
            a, b = rng.permutation(len(xp)), rng.permutation(len(xu))
            for i in range(batches):
                p, u = xp[a[i::batches]], xu[b[i::batches]]
                if not len(p) or not len(u):
                    continue
                x = np.concatenate([p, u])
                h = np.tanh(x @ self.p[0] + self.p[1])
                g = h @ self.p[2] + self.p[3][0]
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                gp, gu = g[: len(p)], g[len(p):]
                d = np.zeros(len(x))
                if risk == "plain":
                    d[: len(p)] = (s[: len(p)] - 1) / len(p)
                    d[len(p):] = s[len(p):] / len(u)
                else:
                    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                    if negative >= 0:
                        d[: len(p)] = prior * (s[: len(p)] - 1) / len(p) - prior * s[: len(p)] / len(p)
                        d[len(p):] = s[len(p):] / len(u)
                    else:  # step back from the negative part alone
                        d[: len(p)] = prior * s[: len(p)] / len(p)
                        d[len(p):] = -s[len(p):] / len(u)
                dh = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [x.T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                step += 1
                for k, grad in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -5, 5)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]


def class_prior(xp: np.ndarray, xu: np.ndarray, hp: np.ndarray, hu: np.ndarray) -> float:
    """An estimate of the share of positives among the unlabelled rows.  Halves are dealt
    by the rows' hashes, so a text that is in both samples is in the same half of both."""
    found = []
    for seed in range(1, 4):  # networks differ on small samples; the middle estimate counts
        p, u = [], []
        for fold in range(2):  # each half is scored by a network that has not seen it
            mine, other = (hp % 2 == fold, hu % 2 == fold), (hp % 2 != fold, hu % 2 != fold)
            if not all(len(x) for x in (xp[mine[0]], xu[mine[1]], xp[other[0]], xu[other[1]])):
                return 0.5
            own = Network(xp[mine[0]], xu[mine[1]], 0.5, "plain", epochs=10, seed=seed)
            p.append(own.margin(xp[other[0]]))
            u.append(own.margin(xu[other[1]]))
        p, u = np.sort(np.concatenate(p)), np.sort(np.concatenate(u))
        cuts = np.quantile(p, np.linspace(0.02, 0.6, 59))
        found.append(((len(u) - np.searchsorted(u, cuts)) / len(u) / ((len(p) - np.searchsorted(p, cuts)) / len(p))).min())
    slack = 1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u))
    return float(np.clip(np.median(found) + slack / 4, 0.05, 0.98))


class Model:
    def __init__(self, xp: np.ndarray, xu: np.ndarray, hp: np.ndarray, hu: np.ndarray):
        self.net = None
        if len(xp) > 1 and len(xu) > 1:
            self.prior = class_prior(xp, xu, hp, hu)
            self.net = Network(xp, xu, self.prior, "pu")

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.net.margin(x.astype(np.float64)), -30, 30)))


def _lowest(rows: DataFrame, most: int) -> DataFrame:
    """``most`` distinct rows of lowest hash ``h``."""
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    below = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, (1.5 * most + 60) / max(1, n))))
    return rows.where(F.col("h") <= below).dropDuplicates(["h"]).orderBy("h").limit(most)


def fit(documents: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the given rows: positives are labelled 1; the unlabelled sample is of all."""
    trusted = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", "text").withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    # Hashes are chosen first, so that no text is shuffled but the sample's.
    keys = rows.select("doc_id", "h")
    p = _lowest(keys.join(trusted, "doc_id", "left_semi").select("h"), positive).withColumn("positive", F.lit(True))
    u = _lowest(keys.select("h"), unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(p.unionByName(u))  # at most positive + unlabelled rows
    sample = rows.select("text", "h").join(chosen, "h").dropDuplicates(["h", "positive"]).select("positive", "text", "h")

    def train(table: pa.Table) -> Model:
        yes = np.array(table["positive"].to_pylist(), bool)
        h = table["h"].to_numpy()
        order = np.lexsort((h, yes))
        x, yes, h = binary_rows(table["x"], WIDTH)[order].astype(np.float64), yes[order], h[order]
        return Model(x[yes], x[~yes], h[yes], h[~yes])

    return fitted(map_arrow(sample, _featured, "positive boolean, x binary, h long"), train) or Model(*[np.zeros((0, WIDTH))] * 2, *[np.zeros(0, np.int64)] * 2)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row of ``documents``."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        for at, offsets, data in wb.runs(batch.column(1)):
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(shipped.value.score(features(data, offsets)))], ["doc_id", "score"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, score double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; rows whose crc32 remainder is 2 teach nothing."""
    out = held_out("doc_id", 4, 2)
    model = fit(documents.where(~out), labels.where(~out))
    return predict(documents, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
