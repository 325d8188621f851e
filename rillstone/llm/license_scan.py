"""License scans with a positional rare-token index, in DataFrame functions only.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters.  A text
that can hold a license phrase is rewritten as one character per word (licence words
have a character of their own, all others are ``.``), so a phrase is a substring and
a place a word index.

* Base: places where a base phrase's words stand consecutively.
* Method: document frequencies of the licence words over *all* texts give their IDF.  Of each
  template the text's ``rare`` highest-IDF words are looked up in the positional index; word
  place minus template place is an alignment, kept where two postings of one template agree
  on it and verified by the template's mandatory key phrase at its place (a template
  without all words of its phrase in the text is not looked up).  ``score`` is the best
  alignment's IDF-weighted share of template words found.

Edge cases: a null or empty text has no words, no labels and score 0; repeated rows
are kept; null ids are carried; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled

# Phrases of the base and the labels they give.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Template, label, mandatory key phrase.
TEMPLATES = [
    ("released under the mit license", "mit", "mit license"),
    ("licensed under the apache license version 2 0", "apache-2", "apache license version 2"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit", "permission is hereby granted free of charge"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", "use this file except in compliance with the license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution and use in source and binary forms"),
    ("this program is free software you can redistribute it and or modify it under the terms of the", "gpl", "this program is free software"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl", "gnu lesser general public license"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software released into the public domain"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
]
_VOCABULARY = sorted({w for t, _, _ in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()})
_CODE = {w: chr(0x100 + i) for i, w in enumerate(_VOCABULARY)}  # one character each
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text.  ``lower`` maps two non-ASCII letters to ASCII ones; they are
    replaced by other non-ASCII characters first, so only A-Z change class."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("")), F.lit("İ"), F.lit(""))
    return F.array_remove(F.split(F.lower(kept), _GAP), "")


def _coded(phrase: str) -> str:
    return "".join(_CODE[w] for w in phrase.split())


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _key_at(template: str, key: str) -> int:
    """The place of the mandatory phrase in its template."""
    tokens, phrase = template.split(), key.split()
    return next(i for i in range(len(tokens)) if tokens[i : i + len(phrase)] == phrase)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 6) -> DataFrame:
    """Per row: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    present = F.array_intersect("words", _literals(_VOCABULARY))
    source = source.select("id", F.size("words").cast("long").alias("n_words"), present.alias("present"), "words")
    may = F.lit(False)
    for phrase in {*BASE, *(key for _, _, key in TEMPLATES)}:
        may = may | (F.size(F.array_intersect("present", _literals(set(phrase.split())))) == len(set(phrase.split())))
    codes = F.create_map(*[F.lit(v) for pair in _CODE.items() for v in pair])
    coded = F.array_join(F.transform("words", lambda w: F.coalesce(F.try_element_at(codes, w), F.lit("."))), "")
    read = Settled(source.select(F.monotonically_increasing_id().alias("row"), "id", "n_words", "present", F.when(may, coded).alias("coded"))).df

    # IDF of the licence words over all texts: at most as many rows as words.
    n = read.count()
    found = {r["w"]: r["n"] for r in read.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    import math

    idf = {w: math.log((1 + n) / (1 + found.get(w, 0))) + 0.01 for w in _VOCABULARY}
    by_rarity = [sorted(set(t.split()), key=lambda w: (-idf[w], w)) for t, _, _ in TEMPLATES]

    text = F.coalesce("coded", F.lit(""))
    count, first, last, base = F.lit(0).cast("long"), [], [], []
    for phrase, label in BASE.items():
        key = _coded(phrase)
        places = ((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("long")
        count = count + places
        at = F.instr(text, key)
        back = F.instr(F.reverse(text), key[::-1])
        first.append(F.when(at > 0, at - 1))
        last.append(F.when(back > 0, F.length(text) - (back - 1) - len(key)))
        base.append(F.when(at > 0, F.lit(label)))
    read = read.select("row", "id", "n_words", "coded", count.alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*base)).alias("base"))

    # The positional index: a posting for each template word.
    index = [(_CODE[w], t, i) for t, (text_, _, _) in enumerate(TEMPLATES) for i, w in enumerate(text_.split())]
    postings = spark.createDataFrame(index, "code string, template int, at int")
    files = read.where("coded IS NOT NULL").select("row", "coded")
    held = lambda w: F.contains(F.col("coded"), F.lit(_CODE[w]))
    asked = []
    for t, (_, _, key) in enumerate(TEMPLATES):
        whole = F.lit(True)
        for w in set(key.split()):
            whole = whole & held(w)
        own = F.slice(F.array_compact(F.array(*[F.when(held(w), F.lit(_CODE[w])) for w in by_rarity[t]])), 1, rare)
        asked.append(F.when(whole, F.struct(F.lit(t).alias("template"), own.alias("own"))))
    hits = files.select("row", "coded", F.inline(F.array_compact(F.array(*asked))))
    places = F.filter(F.transform(F.split("coded", ""), lambda c, i: F.when(F.array_contains(F.col("own"), c), F.struct(i.alias("place"), c.alias("code")))), lambda h: h.isNotNull())
    hits = hits.select("row", "coded", "template", F.explode(places).alias("h")).select("row", "coded", "template", "h.place", "h.code")
    votes = (hits.join(F.broadcast(postings), ["template", "code"]).withColumn("start", F.col("place") - F.col("at"))
             .groupBy("row", "template", "start").agg(F.count("*").alias("votes"), F.first("coded").alias("coded")).where("votes > 1"))
    score, label, verified = F.lit(0.0), F.lit(None).cast("string"), F.lit(False)
    for t, (text_, name, key) in enumerate(TEMPLATES):
        tokens, here = text_.split(), F.col("template") == t
        at = _key_at(text_, key)
        char = lambda i: F.when(F.col("start") + i >= 0, F.substr("coded", F.col("start") + i + 1, F.lit(1)))
        verified = F.when(here, (F.col("start") + at >= 0) & (F.substr("coded", F.col("start") + at + 1, F.lit(len(key.split()))) == _coded(key))).otherwise(verified)
        got = sum((F.when(char(i) == _CODE[w], F.lit(idf[w])).otherwise(0.0) for i, w in enumerate(tokens)), F.lit(0.0))
        score = F.when(here, got / sum(idf[w] for w in tokens)).otherwise(score)
        label = F.when(here, F.lit(name)).otherwise(label)
    matched = votes.where(verified).groupBy("row").agg(F.collect_set(label).alias("more"), F.max(score).alias("score"))
    out = read.join(matched, "row", "left")
    joined = lambda c: F.concat_ws(",", F.array_sort(c))
    every = F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("id", "n_words", "n_base", "first_word", "last_word", joined(F.array_distinct("base")).alias("base_labels"), joined(every).alias("labels"), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(documents).withColumnRenamed("id", "doc_id")
