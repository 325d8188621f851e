"""Collocations against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillstone.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return out


def texts():
    rng = np.random.default_rng(5)
    words = ["the", "old", "stone", "bridge", "Über", "ça", "va", "x\x00y", "a'b", "日本"]
    rows = [("en" if i % 3 else "fr" if i % 2 else None, "".join(words[j] + [" ", " ", "\t", "  ", ", ", ".\n", "\x0b", "! ?", "\r\n"][s] for j, s in zip(rng.integers(0, len(words), 90), rng.integers(0, 9, 90)))) for i in range(40)]
    rows += [("en", "New York City hall and new york CITY hall " * 30), ("en", "la la la la la " * 8), ("en", None), ("de", ""), (None, " \t.. ,"), ("en", "one"), ("fr", "weit " * 5000)]
    return rows + rows[:5]


@pytest.mark.parametrize("least,most,top", [(10, 3, 2000), (2, 3, 20), (3, 4, 2000), (200, 2, 5)])
def test_phrases(spark, least, most, top):
    df = spark.createDataFrame([(*r, "x", 1) for r in texts()], "lang string, text string, phrase string, rank int").repartition(3)
    got = collocations.collocations(df, least, most, top)
    assert Counter(map(tuple, got.collect())) == Counter(plain(texts(), least, most, top))


def test_phrases_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 200)
    monkeypatch.setattr(collocations, "KEYS", 50)
    lists = [b for b in texts() if b[1]]
    df = spark.createDataFrame(lists, "lang string, text string").repartition(2)
    assert collocations.inverted_lists(df).count() > 0
    assert Counter(map(tuple, collocations.collocations(df, 5, 3, 50).collect())) == Counter(plain(lists, 5, 3, 50))


def test_no_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0
