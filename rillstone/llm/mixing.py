"""Mixing sources to target weights by soft membership, in DataFrame functions only.

1. A labelled table gives documents a domain.  A naive Bayes classifier over the
   presence of a learned lexicon (the tokens that tell domains apart best) and of the
   share of distinct tokens is learned on at most ``sample`` labelled documents.
2. Every document gets posteriors over the domains (rounded to three decimals).
3. Non-negative document rates r minimise the squared difference between the expected
   domain totals ``sum_i r_i * tokens_i * p_ik`` and the targets, by projected gradient
   from r = 1 (steps in the token-weighted metric, the error preconditioned by the
   inverse of the domains' second moments, so that rare domains converge as fast as
   common ones; Nesterov momentum restarted when the error grows).  It goes on until the
   rates' error is below ``TOLERANCE``; where targets can't be met (``STEPS`` steps
   without getting 1 % closer), it warns with the error that is left, which is then
   the least in the preconditioned metric.  A document's update depends on
   its posteriors alone, so tokens are first added up by distinct posterior vector, and
   each step is one distributed aggregate that returns a number per domain; rates of all
   documents are then one fold over the collected error vectors.

Edge cases: a null or empty text has no tokens and gets the prior's posteriors and the
rate they imply; documents labelled more than once teach nothing unless the labels
agree; without labelled rows there is one domain, ``all``; a target for a domain no
document can belong to is left out and the others are scaled up; repeated rows are
kept; null ids are carried but teach nothing; an empty table gives an empty result;
columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled

SAMPLE, LEXICON, STEPS, TOLERANCE = 20_000, 400, 60, 1e-4
TARGETS = {"clean": 0.90, "toxic": 0.04, "low": 0.06}
_VARIETY = (0.1, 0.25, 0.4, 0.55, 0.7)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), " "), "")


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of a labels table: low quality, toxic or clean; unequal labels drop out."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    named = labels.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    return named.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other").select("doc_id", "domain")


class Classifier:
    """Log-odds tables of a presence naive Bayes over a lexicon; all bounded in size."""

    def __init__(self, domains: list[str], prior: list[float], words: dict[str, list[float]], variety: list[list[float]]):
        self.domains, self.prior, self.words, self.variety = domains, prior, words, variety


def _variety(distinct: Column, n: Column) -> Column:
    share = distinct / F.greatest(n, F.lit(1))
    return sum(((share > cut).cast("int") for cut in _VARIETY), F.lit(0))


def learn(documents: DataFrame, domains: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on the ``sample`` labelled documents of lowest id hash."""
    labelled = domains.select(F.col("doc_id").alias("key"), "domain").orderBy(F.xxhash64("key"), "key").limit(sample)
    own = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(labelled), "key")
    own = own.select("domain", tokens(F.col("text")).alias("words")).select("domain", F.array_distinct("words").alias("words"), F.size("words").alias("n"))
    own = Settled(own.select("domain", "words", _variety(F.size("words"), F.col("n")).alias("variety"))).df
    sizes = {r[0]: r[1] for r in own.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return Classifier(["all"], [0.0], {}, [[0.0]] * (len(_VARIETY) + 1))
    total = sum(sizes.values())
    spread = {(r["domain"], r["variety"]): r["count"] for r in own.groupBy("domain", "variety").count().collect()}
    counts = own.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(names)])
    rate = [((F.col(f"c{i}") + 0.5) / (sizes[d] + 1.0)) for i, d in enumerate(names)]
    overall = sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0))
    # Information about the domain: documents times the spread of log rates.
    gain = sum((F.col(f"c{i}") * F.abs(F.log(rate[i] * total / (overall + 0.5 * len(names)))) for i in range(len(names))), F.lit(0.0))
    best = counts.where((overall >= 3) & (F.greatest(*rate) * total > 2 * overall) if len(names) > 1 else overall >= 3).select("word", *[r.alias(f"r{i}") for i, r in enumerate(rate)], gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(lexicon).collect()
    words = {r["word"]: [math.log(r[f"r{i}"]) - math.log1p(-min(r[f"r{i}"], 0.999)) for i in range(len(names))] for r in best}
    absent = [sum(math.log1p(-min(r[f"r{i}"], 0.999)) for r in best) for i in range(len(names))]
    prior = [math.log(sizes[d] / total) + absent[i] for i, d in enumerate(names)]
    variety = [[math.log((spread.get((d, v), 0) + 0.5) / (sizes[d] + 0.5 * (len(_VARIETY) + 1))) for d in names] for v in range(len(_VARIETY) + 1)]
    return Classifier(names, prior, words, variety)


def _item(i: int):
    return lambda x: x[i]


def with_posteriors(documents: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``row`` (the document's columns), ``n_tokens`` and ``posteriors`` (in the order of ``model.domains``)."""
    k, columns = len(model.domains), documents.columns
    names = F.array(*[F.lit(w) for w in model.words]) if model.words else F.array().cast("array<string>")
    read = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), tokens(F.col(text_col)).alias("_words")).withColumn("_distinct", F.array_distinct("_words"))
    read = read.withColumn("n_tokens", F.size("_words").cast("long")).withColumn("_variety", _variety(F.size("_distinct"), F.size("_words")))
    read = read.withColumn("_seen", F.array_intersect("_distinct", names)).drop("_words", "_distinct")
    if model.words:
        table = F.create_map(*[x for w, v in model.words.items() for x in (F.lit(w), F.array(*[F.lit(float(y)) for y in v]))])
        read = read.withColumn("_seen", F.transform("_seen", lambda w: F.try_element_at(table, w)))
    else:
        read = read.withColumn("_seen", F.array().cast("array<array<double>>"))
    logs = []
    for i in range(k):
        seen = F.aggregate(F.transform("_seen", _item(i)), F.lit(0.0), lambda a, x: a + x)
        logs.append(F.lit(float(model.prior[i])) + seen + F.array(*[F.lit(float(v[i])) for v in model.variety])[F.col("_variety")])
    read = read.withColumn("_log", F.array(*logs))
    shifted = F.transform("_log", lambda x: F.exp(x - F.array_max("_log")))
    read = read.withColumn("_e", shifted)
    share = F.transform("_e", lambda x: F.round(x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b), 3))
    return read.select("row", "n_tokens", share.alias("posteriors"))


def _state(errors: list[list[float]], momenta: list[float], start: Column | None = None, column: str = "posteriors") -> Column:
    """After the given steps, as a fold: the rate ``r`` and the extrapolated point ``at``."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("at")) if start is None else start
    if not errors:
        return start
    past = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in e]).alias("e"), F.lit(float(m)).alias("m")) for e, m in zip(errors, momenta)])
    k = len(errors[0])

    def fold(state, now):
        moved = state["at"] - sum((F.col(column)[i] * now["e"][i] for i in range(k)), F.lit(0.0))
        new = F.greatest(F.lit(0.0), moved)
        return F.struct(new.alias("r"), (new + now["m"] * (new - state["r"])).alias("at"))

    return F.aggregate(past, start, fold)


def fit_rates(weighed: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    """A column with the rate of rows that have ``n_tokens`` and ``posteriors``."""
    k = len(domains)
    cells = Settled(weighed.where("n_tokens > 0").groupBy("posteriors").agg(F.sum("n_tokens").alias("n"))).df
    cells = cells.coalesce(max(1, cells.count() // 100_000))
    p = [F.col("posteriors")[i] for i in range(k)]
    first = cells.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * p[i]).alias(f"t{i}") for i in range(k)], *[F.sum(F.col("n") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    total = float(first["n"] or 0)
    if not total:
        return F.lit(1.0)
    have = [float(first[f"t{i}"] or 0) / total for i in range(k)]
    wanted = [max(0.0, targets.get(d, 0.0)) if have[i] > 0 else 0.0 for i, d in enumerate(domains)]
    scale = sum(wanted)
    wanted = [w / scale for w in wanted] if scale else have
    matrix = [[float(first[f"m{i}_{j}"] or 0) / total for j in range(k)] for i in range(k)]
    inverse = np.linalg.pinv(np.array(matrix), rcond=1e-9, hermitian=True)  # with it the largest curvature is 1
    state = Settled(cells.select("posteriors", "n", F.lit(1.0).alias("r"), F.lit(1.0).alias("at"))).df
    errors, momenta, best, age, done = [], [], math.inf, 1.0, 0
    closest, since = math.inf, 0
    while True:
        here = state.select("posteriors", "n", _state(errors[done:], momenta[done:], F.struct("r", "at")).alias("s")).select("posteriors", "n", "s.*")
        if len(errors) - done == 20:  # written, so that a step's cost doesn't grow
            state, done = Settled(here).df, len(errors)
            here = state
        now = here.agg(*[F.sum(F.col("n") * F.col(c) * p[i]) for c in ("r", "at") for i in range(k)]).first()
        left, error = ([float(now[j + i]) / total - wanted[i] for i in range(k)] for j in (0, k))
        off, size = (math.sqrt(sum(e * e for e in x)) for x in (left, error))
        if off <= tolerance:
            break
        closest, since = (off, 0) if off < 0.99 * closest else (closest, since + 1)
        move = inverse @ error
        if since >= steps or np.abs(move).max() < 1e-12:
            warnings.warn(f"mixing: targets are missed by {off:.2g}: " + ", ".join(f"{d} {e:+.2g}" for d, e in zip(domains, left)), stacklevel=2)
            break
        if size > best:
            age = 1.0
        best, older = min(best, size), age
        age = (1 + math.sqrt(1 + 4 * age * age)) / 2
        errors.append(move.tolist())
        momenta.append((older - 1) / age)
    return _state(errors, momenta)["r"]


def mix(documents: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, **how) -> DataFrame:
    """``documents`` with ``domain`` (the likeliest), ``posterior``, ``n_tokens`` and ``rate``.

    ``rate`` is the number of times a loader should take the document; every row stays.
    """
    added = ["domain", "posterior", "n_tokens", "rate", "posteriors"]
    documents = documents.drop(*[c for c in documents.columns if c in added])
    model = learn(documents, domains, **how)
    weighed = Settled(with_posteriors(documents, model)).df
    rate = fit_rates(weighed, model.domains, TARGETS if targets is None else targets)
    top = F.array_max("posteriors")
    name = F.array(*[F.lit(d) for d in model.domains])[(F.array_position("posteriors", top) - 1).cast("int")]
    return weighed.select("row.*", name.alias("domain"), top.alias("posterior"), "n_tokens", "posteriors", rate.alias("rate"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document, without its text."""
    return mix(documents.select("doc_id", "text"), label_domains(labels)).drop("text")
