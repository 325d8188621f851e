"""Words of Arrow text columns as spans of bytes, cut by numpy: no Python object for a word.

Rules are those of ``functions.text``; ``tests/test_spans.py`` holds both against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import EN_SUFFIXES, RU_SUFFIXES, STOP

_CODES = np.arange(256)
_UPPER, _LOW = (_CODES >= 65) & (_CODES <= 90), (_CODES >= 97) & (_CODES <= 122)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
_STOP = frozenset(STOP)
_FOLDS = [re.compile(f"^(.{{3,}}?)(?:{'|'.join(s)})$") for s in (RU_SUFFIXES, EN_SUFFIXES)]
_RUSSIAN = re.compile("[а-яё]")
MOST_KNOWN = 500_000  # words whose terms a process keeps

_known: dict[bytes, str | None] = {}


def runs(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, offsets, bytes)`` for runs of rows of about ``limit`` bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, values = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = min(max(int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1, row + 1), len(column))
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def spans(inside: np.ndarray, cut: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are ``inside``, ended before every place that is ``cut`` and at rows'
    borders: their starts and ends, and the number of each row's first one."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def borders(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether a row begins at a byte."""
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    return out[:n]


def raw_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text.raw_words`` of a run of rows: which bytes are of words, and their spans."""
    n = len(data)
    first = borders(offsets, n)
    upper, low, digit = _UPPER[data], _LOW[data], _DIGIT[data]
    inside, cut = upper | low | digit, first.copy()
    lead, trail = data[:-1], data[1:]
    letter = ((lead == 0xD0) & (((trail >= 0x90) & (trail <= 0xBF)) | (trail == 0x81))) | ((lead == 0xD1) & (((trail >= 0x80) & (trail <= 0x8F)) | (trail == 0x91)))
    inside[:-1] |= letter
    inside[1:] |= letter
    cut[1:] |= (low | digit)[:-1] & upper[1:]  # aB
    cut[1:-1] |= upper[:-2] & upper[1:-1] & (low & ~first)[2:]  # ABc
    return inside, *spans(inside, cut, offsets)


_PLAIN = _LOW | _DIGIT | (_CODES == 39)
_ENDS, _GAP = np.isin(_CODES, [33, 46, 63]), np.isin(_CODES, [9, 10, 13, 32])


def plain_words(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of ``text.spaced_words`` of a run of lower-cased rows, as spans."""
    inside = _PLAIN[data]
    return spans(inside, borders(offsets, len(data)) if cut is None else cut, offsets)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of ``size`` words from ``begin`` on each, with a blank between words."""
    word = np.repeat(begin - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    length = ends[word] - starts[word] + 1  # with the blank before it
    upto = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(starts[word] - 1 - upto[:-1], length) + np.arange(upto[-1])
    out = data[np.maximum(place, 0)]
    out[upto[:-1]] = 32
    keep = np.ones(len(out), bool)
    heads = np.concatenate([[0], np.cumsum(size)])
    keep[upto[heads[:-1]]] = False
    text_ends = upto[heads] - np.arange(len(heads))
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(text_ends.astype(np.int64)), pa.py_buffer(out[keep])])


def _said(ids: pa.Array, texts: pa.Array, least: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Ids and sentences of ``text.sentences`` of lower-cased rows, repeats of a row left out, and how
    many the row has."""
    for at, offsets, data in runs(texts):
        if not len(data):
            continue
        n = len(data)
        starts, ends, first = plain_words(data, offsets)
        stops = np.zeros(n + 1, np.int64)  # sentence ends before a byte
        stops[2:] = np.cumsum(_ENDS[data[:-1]] & _GAP[data[1:]] & ~borders(offsets, n)[1:])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        sentence = stops[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(starts)))
        begin, size = begin[size >= least], size[size >= least]
        if not len(begin):
            continue
        words = _joined(data, starts, ends, begin, size)
        code = words.dictionary_encode()
        key = row[begin] * len(code.dictionary) + code.indices.to_numpy()
        _, once = np.unique(key, return_index=True)
        own = row[begin][once]
        yield ids.take(pa.array(own + at)), words.take(pa.array(once)).cast(pa.string()), pa.array(np.bincount(own)[own].astype(np.int64))


def row_sentences(texts: DataFrame, least: int = 8, sized: bool = False) -> DataFrame:
    """``(id, s)`` of ``texts(id, text)``: distinct normalised sentences within each row, without
    a shuffle; as ``text.sentences``, lower-cased by Spark.  ``sized``: with their number as ``n``."""
    names = ["id", "s", "n"][: 2 + sized]

    def run(batches):
        for batch in batches:
            for columns in _said(batch.column(0), batch.column(1), least):
                yield pa.RecordBatch.from_arrays([*columns[: len(names)]], names)

    return texts.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, s string" + ", n long" * sized)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, byte by byte over all words at once, the longest last."""
    size = ends - starts
    out = size.astype(np.uint64) * _STEP
    order = np.argsort(-size, kind="stable")
    longest = -size[order]
    for i in range(int(size.max(initial=0))):
        some = order[: np.searchsorted(longest, -i)]
        out[some] = (out[some] ^ data[starts[some] + i]) * np.uint64(0xD6E8FEB86659FD93)
        out[some] ^= out[some] >> np.uint64(32)
    return _mixed(out)


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of lower-cased rows: the first row, the 64-bit hashes of each row's distinct shingles of
    ``n`` plain words, sorted, and where each row's begin.  Rows of fewer words have none."""
    for at, offsets, data in runs(texts):
        if not len(data):
            yield at, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
            continue
        starts, ends, first = plain_words(data, offsets)
        words = _word_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        made = max(0, len(words) - n + 1)
        grams = np.zeros(made, np.uint64)
        for i in range(n):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[i : i + made]
        whole = row[:made] == row[n - 1 : n - 1 + made]
        grams, row = _mixed(grams[whole]), row[:made][whole]
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[keep], row[keep]
        yield at, grams, np.searchsorted(row, np.arange(len(offsets)))


def row_shingles(texts: DataFrame, n: int = 5) -> DataFrame:
    """``(id, n, set)`` of ``texts(id, text)``: the distinct shingle hashes of each row, sorted, as long."""

    def run(batches):
        for batch in batches:
            for at, grams, begin in shingle_sets(batch.column(1), n):
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), pa.array(np.diff(begin).astype(np.int64)), lists], ["id", "n", "set"])

    return texts.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n long, set array<long>")


def row_grams(texts: DataFrame, parts: int, n: int = 5, most: int = 1 << 21) -> DataFrame:
    """``(id, n, h)``: what ``row_shingles`` gives, a row for each hash.  About ``most`` of them at a time
    come in the order of ``pmod(h, parts)``, so that a sort by it finds whole runs."""

    def ordered(held):
        ids, grams, size = pa.concat_arrays([x for x, *_ in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
        order = np.argsort(np.mod(grams.view(np.int64), parts).astype(np.int16), kind="stable")  # a radix sort
        row = np.repeat(np.arange(len(size)), size)[order]
        grams = grams[order].view(np.int64)
        for i in range(0, len(row), 1 << 16):
            own = row[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(size[own]), pa.array(grams[i : i + (1 << 16)])], ["id", "n", "h"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for at, grams, begin in shingle_sets(batch.column(1), n):
                held.append((batch.column(0).slice(at, len(begin) - 1), grams, np.diff(begin).astype(np.int64)))
                count += len(grams)
                if count >= most:
                    yield from ordered(held)
                    held, count = [], 0
        if held:
            yield from ordered(held)

    return texts.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n long, h long")


def shared_counts(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``pairs`` with ``c``, the number of common elements of the arrays ``x`` and ``y`` of distinct longs, in their place."""
    kept = [c for c in pairs.columns if c not in (x, y)]

    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in (x, y))
            made = [len(np.intersect1d(p.values.to_numpy(), q.values.to_numpy(), assume_unique=True)) for p, q in zip(a, b)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(made, pa.int64())], [*kept, "c"])

    fields = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in kept)
    return pairs.mapInArrow(run, f"{fields}, c long")


def term(word: bytes) -> str | None:
    """A word's term; null where ``text.kept`` drops it."""
    w = word.decode().lower()
    if (len(w) == 1 and not "0" <= w <= "9") or w in _STOP:
        return None
    return _FOLDS[0 if _RUSSIAN.search(w) else 1].sub(r"\1", w)


def _terms(words: list[bytes]) -> list[str | None]:
    if len(_known) > MOST_KNOWN:
        _known.clear()
    out = []
    for w in words:
        if w not in _known:
            _known[w] = term(w)
        out.append(_known[w])
    return out


def counted(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """``(id, term, f, dl)`` of rows of texts, each row for itself; ``dl``: tokens of the row."""
    for at, offsets, data in runs(texts):
        if not len(data):
            continue
        inside, starts, ends, first = raw_words(data, offsets)
        upto = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        own = _terms(words.dictionary.to_pylist())
        codes: dict[str, int] = {}
        code_of = np.array([-1 if x is None else codes.setdefault(x, len(codes)) for x in own], np.int64)
        code = code_of[words.indices.to_numpy()]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[code >= 0]
        code = code[code >= 0]
        length = np.bincount(row, minlength=len(offsets) - 1)
        keys, f = np.unique(row * max(1, len(codes)) + code, return_counts=True)
        row, code = np.divmod(keys, max(1, len(codes)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + at)), pa.array(list(codes), pa.string()).take(pa.array(code)), pa.array(f.astype(np.int64)), pa.array(length[row].astype(np.int64))], ["id", "term", "f", "dl"])


def row_counts(texts: DataFrame) -> DataFrame:
    """``(id, term, f, dl)`` of ``texts(id, text)``, counted within each row: no shuffle."""

    def run(batches):
        for batch in batches:
            yield from counted(batch.column(0), batch.column(1))

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, term string, f long, dl long")
