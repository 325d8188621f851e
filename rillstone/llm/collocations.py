"""Collocations: frequent phrases by vertical positional inverted lists.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words
at blanks and tabs.  Blocks of texts of one language become *inverted lists*: for each
word of the block its positions, in order (``inverted_lists``); pieces lie one position
apart, so no phrase spans two.  The lists are written once; every level reads them.

Level k merge-joins the occurrence list of the phrases of k - 1 words with the one a
position later: where both hold, the k - 1 words go on with a word that is the end of a
frequent phrase itself.  A phrase's frequency is the length of its list, added up over
blocks.  A phrase can only be frequent if the two phrases of one word less inside it
are; which those are is known first from hashed counts (equal hashes only ever add up,
so no frequent phrase is lost), kept in a Bloom filter of at most 8 MB; phrases
that pass are counted once more by their words.  Scores, containment and ranks are joins
and windows over the frequent phrases.

Within a block a word is known by a 64-bit hash of its bytes.

Edge cases: null texts are empty; a null language is ``und``; repeated rows count
again; texts without words and empty tables give no phrase; ties are ordered by the
phrase's bytes; a long text is never cut; other columns are ignored.  A word may hold
any character but the separators.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbytes
from .common import Settled, bloom, bloom_size, give_back, in_bloom, let_go

LEAST, WORDS, TOP, INSIDE = 10, 3, 2000, 50
BLOCK, KEYS, GROUP = 256 << 10, 3 << 20, 4 << 20  # rows and row groups small enough for a heap of regions
PER_TASK, BUFFER = 8 << 20, 1 << 19  # words whose counts meet in a task; rows that it adds up at a time
_CODES = np.arange(256)
CUT = np.isin(_CODES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
WORD = ~(CUT | (_CODES == 32) | (_CODES == 9))
_LISTS = "lang string, n long, words binary, lengths binary, steps binary"
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in two or four bytes each, plane by plane."""
    kind = np.uint16 if numbers.max() < 1 << 16 else np.int32
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _wide(small, n: int) -> np.ndarray:
    planes = np.frombuffer(small, np.uint8).reshape(-1, n).T.copy()
    return planes.view(np.uint16 if planes.shape[1] == 2 else np.int32)[:, 0].astype(np.int64)


def _lists_of(data, offsets, langs):
    """``(lang code, number of words, words, lengths, steps)`` of one run of texts, for each language in it."""
    hashes, starts, ends, first = wordbytes.words(data, offsets, WORD)
    if not len(hashes):
        return
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    piece = np.cumsum(CUT[data], dtype=np.int32)[starts] + row.astype(np.int32)
    place = np.arange(len(hashes), dtype=np.int64)
    place[1:] += np.cumsum(piece[1:] != piece[:-1])
    spoken = langs[row]
    for code in np.unique(spoken):
        own = np.flatnonzero(spoken == code)
        own = own[np.argsort(hashes[own], kind="stable")]
        sign, at = hashes[own], place[own]
        head = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
        lengths = np.diff(np.r_[head, len(own)])
        step = np.r_[at[0], np.diff(at)]
        step[head] = at[head]
        size = ends[own[head]] - starts[own[head]] + 1  # a blank after each word
        stop = np.cumsum(size)
        source = np.arange(stop[-1]) + np.repeat(starts[own[head]] - (stop - size), size)
        words = wordbytes.LOWER[data[np.minimum(source, len(data) - 1)]]
        words[stop - 1] = 32
        yield code, len(own), words.tobytes(), _small(lengths), _small(step)


def inverted_lists(texts: DataFrame) -> DataFrame:
    """The blocks' inverted lists of ``texts(lang, text)``."""

    def run(batches):
        for batch in batches:
            named = batch.column(0).fill_null("und").dictionary_encode()
            langs, names = named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()
            for first, offsets, data in wordbytes.runs(batch.column(1), BLOCK):
                made = [(names[c], *x) for c, *x in _lists_of(data, offsets, langs[first : first + len(offsets) - 1])]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["lang", "n", "words", "lengths", "steps"])
        give_back()

    return texts.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, _LISTS)


class _Block:
    """One row of the inverted lists: words, their hashes, and which word stands at each position."""

    def __init__(self, lang: str, words, lengths, steps=None):
        self.lang, self.bytes = lang, np.frombuffer(words, np.uint8)
        self.lengths = _wide(lengths, int((self.bytes == 32).sum()))
        seed = np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % (1 << 64))
        self.hashes = wordbytes.mix(wordbytes.words(self.bytes, np.array([0, len(self.bytes)]), WORD)[0] ^ seed)
        self.steps = steps

    def words(self) -> pa.Array:
        stop = np.flatnonzero(self.bytes == 32) + 1
        offsets = np.r_[0, stop].astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(stop), pa.py_buffer(offsets), pa.py_buffer(self.bytes.tobytes()))
        return pc.utf8_slice_codeunits(text, 0, -1) if len(text) else text

    def places(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the lists in ``live``, merged in order, and each one's list."""
        step = _wide(self.steps, int(self.lengths.sum()))
        total, head = np.cumsum(step), np.cumsum(self.lengths) - self.lengths
        at = total - np.repeat(total[head] - step[head], self.lengths)
        owner = np.full(int(at.max()) + 1, -1, np.int32)
        keep = np.repeat(live, self.lengths)
        owner[at[keep]] = np.repeat(np.arange(len(live), dtype=np.int32), self.lengths)[keep]
        return np.flatnonzero(owner >= 0), owner

    def levels(self, filters: list, most: int):
        """``(k, positions, keys, owner)`` of the phrases of k words whose shorter parts pass ``filters``."""
        live = in_bloom(filters[0], self.hashes) if filters else np.ones(len(self.hashes), bool)
        if most == 1 or not live.any():
            return
        here, owner = self.places(live)
        keys = self.hashes[owner[here]]
        for k in range(2, most + 1):
            joined = here[:-1] + 1 == here[1:]  # the phrase a position later occurs, too
            here = here[:-1][joined]
            keys = wordbytes.mix(keys[:-1][joined] * _FACTOR + self.hashes[owner[here + k - 1]])
            if k <= len(filters):
                keep = in_bloom(filters[k - 1], keys)
                here, keys = here[keep], keys[keep]
            yield k, here, keys, owner


def _blocks(batch: pa.RecordBatch):
    """The blocks of a batch, one at a time and without a copy of their bytes."""
    for i in range(batch.num_rows):
        yield _Block(batch.column(0)[i].as_py(), *(c[i].as_buffer() for c in batch.columns[1:]))


def _added(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[head], np.minimum(np.add.reduceat(counts, head), least) if len(head) else counts


def _packed(keys: np.ndarray) -> bytes:
    """Rising keys as the bytes of their steps, plane by plane: the upper planes are nearly empty."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64)[:, 0])


def _frequent(lists: DataFrame, filters: list, k: int, least: int, words: int) -> np.ndarray:
    """A Bloom filter that passes every phrase of ``k`` words that occurs ``least`` times."""
    kind, slices = np.uint8 if least < 128 else np.int64, 1 + words // (KEYS // 4)

    def counted(batches):
        held, size = [], 0

        def out():
            keys, counts = _added(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), least)
            part = ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
            for a in range(0, len(edge) - 1, 512):
                cut = [(int(part[i]), _packed(keys[i:j]), counts[i:j].astype(kind).tobytes()) for i, j in zip(edge[a : a + 512], edge[a + 1 : a + 513])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cut), (pa.int64(), pa.binary(), pa.binary()))], ["part", "keys", "counts"])

        for batch in batches:
            for block in _blocks(batch):
                if k == 1:
                    keys, counts = block.hashes, np.minimum(block.lengths, least)
                else:
                    keys = None
                    for level, _, keys, _ in block.levels(filters, k):
                        pass
                    if keys is None:
                        continue
                    keys, counts = _added(keys, np.ones(len(keys), np.int64), least)
                held.append((keys, counts))
                size += len(keys)
                if size > KEYS:
                    joined = _added(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), least)
                    held[:], size = [joined], len(joined[0])
                    if size > KEYS // 2:
                        yield from out()
                        held.clear()
                        size = 0
        if size:
            yield from out()
        held.clear()
        give_back()

    def summed(batches):
        held, part = [], None

        def out():
            keys, counts = _added(np.concatenate([_unpacked(x) for x, _ in held]), np.concatenate([np.frombuffer(x, kind) for _, x in held]).astype(np.int64), least)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= least].view(np.int64))], ["key"])

        for batch in batches:
            for p, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if held and p != part:
                    yield from out()
                part = p
                held.append((keys, counts))
        if held:
            yield from out()
        give_back()

    read = lists.select("lang", "words", "lengths", *["steps"] * (k > 1))
    parts = read.coalesce(1 + words // PER_TASK).mapInArrow(counted, "part long, keys binary, counts binary").repartition("part").sortWithinPartitions("part")
    found = Settled(parts.mapInArrow(summed, "key long"))
    made = bloom(found.df, bloom_size(found.df.count()))
    found.free()
    return made


def _counts(lists: DataFrame, filters: list, most: int, words: int) -> DataFrame:
    """``(lang, k, phrase, n)``: lengths of the lists that pass the filters, for each block."""

    def run(batches):
        held = []

        def table(lang, k, phrases, n):
            return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "k": np.full(len(phrases), k, np.int32), "phrase": phrases.cast(pa.string()), "n": n.astype(np.int64)})

        def added_up():
            sums = pa.TableGroupBy(pa.concat_tables(held), ["lang", "k", "phrase"]).aggregate([("n", "sum")])
            held.clear()
            yield from sums.select(["lang", "k", "phrase", "n_sum"]).rename_columns(["lang", "k", "phrase", "n"]).to_batches(1 << 16)

        for batch in batches:
            for block in _blocks(batch):
                words = block.words()
                keep = np.flatnonzero(in_bloom(filters[0], block.hashes))
                held.append(table(block.lang, 1, words.take(pa.array(keep)), block.lengths[keep]))
                for k, here, keys, owner in block.levels(filters, most):
                    if not len(here):
                        continue
                    order = np.lexsort([owner[here + i] for i in range(k)])
                    said = np.stack([owner[here[order] + i] for i in range(k)])
                    head = np.flatnonzero(np.r_[True, (said[:, 1:] != said[:, :-1]).any(axis=0)])
                    parts = [words.take(pa.array(said[i, head])) for i in range(k)]
                    held.append(table(block.lang, k, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), np.diff(np.r_[head, said.shape[1]])))
                if sum(t.num_rows for t in held) > BUFFER:
                    yield from added_up()
        if held:
            yield from added_up()
        give_back()

    return lists.select("lang", "words", "lengths", "steps").coalesce(1 + words // PER_TASK).mapInArrow(run, "lang string, k int, phrase string, n long")


def phrases(texts: DataFrame, least: int = LEAST, most: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to ``most`` words that occur ``least`` times, ``(lang, k, phrase, a)``, and the words of each language, ``(lang, n)``."""
    lists = Settled(inverted_lists(texts), GROUP, "zstd")
    spoken = Settled(lists.df.groupBy("lang").agg(F.sum("n").alias("n"))).df
    words = spoken.agg(F.sum("n")).first()[0] or 0
    filters: list = []
    for k in range(1, most + 1):
        filters.append(_frequent(lists.df, filters, k, least, words))
        let_go(texts.sparkSession)
    counted = _counts(lists.df, filters, most, words).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    found = Settled(counted).df
    lists.free()
    return found, spoken


def _head(k: int):
    return F.substring_index("phrase", " ", k)


def _tail(k: int):
    return F.substring_index("phrase", " ", -k)


def collocations(texts: DataFrame, least: int = LEAST, most: int = WORDS, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The first ``top`` phrases of each language by their weakest cut, without those that lie
    in a longer one which makes up ``inside`` percent of them."""
    found, spoken = phrases(texts, least, most)
    known = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    scored = []
    for k in range(2, most + 1):
        own = found.where(F.col("k") == k).select("lang", "phrase", "a")
        for cut in range(1, k):
            own = _with(_with(own, known, _head(cut), f"l{cut}"), known, _tail(k - cut), f"r{cut}")
        cuts = [F.struct(F.expr(f"CAST((1000000BD * CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0))) DIV (CAST(l{c} AS decimal(19,0)) * CAST(r{c} AS decimal(19,0))) AS bigint)").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
        scored.append(own.select("lang", F.lit(k).alias("k"), "phrase", "a", F.array_min(F.array(*cuts)).alias("c")))
    whole = scored[0]
    for x in scored[1:]:
        whole = whole.unionByName(x)
    longer = found.where(F.col("k") > 2)
    held = [longer.where(F.col("k") == k).select("lang", F.substring_index(_head(start + size), " ", -size).alias("phrase"), F.col("a").alias("b")) for k in range(3, most + 1) for size in range(2, k) for start in range(k - size + 1)]
    if held:
        parts = held[0]
        for x in held[1:]:
            parts = parts.unionByName(x)
        parts = parts.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
        whole = whole.join(parts, ["lang", "phrase"], "left").where(F.col("b").isNull() | (F.lit(100) * F.col("b") < F.lit(inside) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(spoken, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def _with(own: DataFrame, known: DataFrame, part, name: str) -> DataFrame:
    """``own`` with the frequency of one part of its phrase."""
    return own.withColumn("part", part).join(known.withColumnRenamed("f", name), ["lang", "part"]).drop("part")


def report(documents: DataFrame) -> DataFrame:
    return collocations(documents.select("lang", "text"))
