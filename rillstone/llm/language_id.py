"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier per code bit is learned on
hashed byte n-grams (2 and 3 bytes, A-Z lower-cased) by ridge regression to +-1.
A text's margins are decoded by loss: the language whose codeword has the
smallest sum of logistic losses, each bit weighted by its training accuracy.  A
text whose two best languages are closer than ``gap`` in probability is flagged
ambiguous.

Learning uses at most ``rows`` rows, dealt evenly to all languages and at most
``per_language`` each (distinct pairs of id and text with the lowest hashes; a threshold on
the hash leaves a few times that many, before anything is sorted).  Every language is
learned: the number of bits grows with the logarithm of their number.  The model is fitted
in one task and only its weights reach the driver; texts are always read whole.

Edge cases: a null text or one without a letter is ``und`` with score 0; a
letter is a character for which ``str.isalpha`` holds; rows whose language is null teach nothing; with one known language every text with a
letter gets it; with none every text is ``und``; null ids count as not held out
but teach nothing; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import binary_rows, fitted, held_out, map_arrow

BUCKETS = 4096
PER_LANGUAGE, ROWS = 600, 9600
UNKNOWN = "und"

_ASCII_LETTER = ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122) & (np.arange(256) < 128)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-byte and of the 2-byte gram that begins at each byte (grams
    that would cross into the next row wrap into spaces)."""
    low = np.concatenate([wb.LOWER[data], np.full(2, 32, np.uint8)]).astype(np.uint32)
    one, two, three = low[:-2], low[1:-1].copy(), low[2:].copy()
    last = offsets[1:][np.diff(offsets) > 0] - 1
    two[last] = 32
    three[last] = 32
    before = last[last > 0] - 1
    three[before] = 32
    pair = one * np.uint32(0x9E3779B1) ^ two * np.uint32(0x85EBCA77)
    triple = pair ^ three * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - 11)
    return (pair * np.uint32(0x27D4EB2F) >> shift).astype(np.int64), (triple * np.uint32(0x165667B1) >> shift).astype(np.int64) + BUCKETS // 2


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for r in np.flatnonzero(~found):
        found[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _histograms(batch: pa.RecordBatch):
    for at, offsets, data in wb.runs(batch.column(1)):
        pair, triple = _buckets(data, offsets)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            counts = np.bincount(pair[a:b], minlength=BUCKETS) + np.bincount(triple[a:b], minlength=BUCKETS)
            out.append((counts / max(1, 2 * (b - a))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)).cast(pa.string()), pa.array(out, pa.binary()), batch.column(2).slice(at, len(out))], ["lang", "x", "h"])


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """An n x bits matrix of +-1 with distinct rows: exhaustive up to 7 classes,
    beyond that the best (largest least distance) of some random matrices."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng, best, score = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        least = apart.min() if (np.abs(code.sum(0)) < n).all() else -1
        if least > score:
            best, score = code, least
    return best


class Model:
    """Languages, codewords, per-bucket bit weights, offsets and bit reliabilities; ``x`` is used up."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 0.3):
        self.names, self.code = names, codewords(len(names))
        if len(names) < 2:
            self.weights, self.bias, self.trust = np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1)
            return
        spread = np.sqrt(x.mean(0, dtype=np.float64) + 1e-6)
        x /= spread.astype(x.dtype)  # in place: the sample is the task's largest object
        middle = x.mean(0, dtype=np.float64)
        x -= middle.astype(x.dtype)
        share = np.bincount(y, minlength=len(names)) / len(y)
        row = np.sqrt(1 / (share[y] * len(names))).astype(x.dtype)  # every language weighs the same
        target = self.code[y]
        x *= row[:, None]
        wanted = ((target - target.mean(0)) * row[:, None]).astype(x.dtype)
        few = len(y) <= BUCKETS  # the smaller of the two equal forms of ridge regression
        gram = (x @ x.T if few else x.T @ x).astype(np.float64)
        gram[np.diag_indices(len(gram))] += ridge
        w = x.T @ np.linalg.solve(gram, wanted).astype(x.dtype) if few else np.linalg.solve(gram, x.T @ wanted).astype(x.dtype)
        self.bias = target.mean(0) - middle @ w
        self.weights = w / spread[:, None]
        right = ((x @ w.astype(x.dtype) / row[:, None] + target.mean(0)) * target > 0).mean(0)
        self.trust = np.clip(2 * right - 1, 0.05, 1)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        pair, triple = _buckets(data, offsets)
        size = np.diff(offsets)
        out = np.zeros((len(size), self.weights.shape[1]))
        some = size > 0
        if some.any():
            for bit in range(out.shape[1]):
                w = np.ascontiguousarray(self.weights[:, bit])
                each = w[pair]
                each += w[triple]
                out[some, bit] = np.add.reduceat(each, offsets[:-1][some]) / (2 * size[some])
        return out + self.bias

    def decode(self, margins: np.ndarray, sharp: float = 4.0) -> np.ndarray:
        """Probabilities by language from loss-weighted distances to the codewords."""
        loss = np.zeros((len(margins), len(self.names)))
        for k, word in enumerate(self.code):
            loss[:, k] = (np.logaddexp(0, -sharp * margins * word) * self.trust).sum(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Model:
    """Learn from a bounded sample: ``per_language`` rows of each language, ``rows`` in all."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    known = sorted(sizes)
    if not known:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0, int))
    each = max(1, min(per_language, rows // len(known)))
    spark = labelled.sparkSession
    # Hashes are evenly spread: below this one are a few times the wanted number of rows.
    below = [(name, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, (3 * each + 60) / max(1, n))))) for name, n in sizes.items()]
    near = usable.join(F.broadcast(spark.createDataFrame(below, "lang string, below long")), "lang").where("h <= below")
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", "h")
    sample = near.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text", "h")  # chosen: at most each * languages

    def train(table: pa.Table) -> Model:
        names = np.array(table["lang"].to_pylist())
        order = np.lexsort((table["h"].to_numpy(), names))
        found = sorted(set(names.tolist()))
        return Model(found, binary_rows(table["x"], BUCKETS)[order], np.searchsorted(found, names[order]))

    return fitted(map_arrow(sample, _histograms, "lang string, x binary, h long"), train)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", gap: float = 0.05) -> DataFrame:
    """``documents``' rows with ``lang_pred``, ``score`` and ``ambiguous`` added."""
    documents = documents.drop("lang_pred", "score", "ambiguous")
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    place, names_out = documents.columns.index(text_col), [*documents.columns, "lang_pred", "score", "ambiguous"]
    added = "lang_pred string, score double, ambiguous boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", " + added

    def step(batch):
        own = shipped.value
        for at, offsets, data in wb.runs(batch.column(place)):
            n = len(offsets) - 1
            letter = _has_letter(data, offsets)
            if own.names:
                p = own.decode(own.margins(data, offsets))
                ranked = np.sort(p, axis=1)
                best, score = p.argmax(1), ranked[:, -1]
                close = (ranked[:, -1] - ranked[:, -2] < gap) if len(own.names) > 1 else np.zeros(n, bool)
                names = [own.names[k] if ok else UNKNOWN for k, ok in zip(best, letter)]
            else:
                score, close, names = np.zeros(n), np.ones(n, bool), [UNKNOWN] * n
            columns = [*batch.slice(at, n).columns, pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(close | ~letter)]
            yield pa.RecordBatch.from_arrays(columns, names_out)

    return map_arrow(documents, step, schema)


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns; rows whose crc32 remainder is 0 teach nothing."""
    model = fit(documents.where(~held_out("doc_id", 5, 0)))
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
