"""Tokens, corpus statistics, BM25 retrieval and its evaluation.

``Index`` is the library's form: built from any texts, saved and loaded, searched with any
queries, evaluated on any cases.  The registered queries run it over the shared tables; their
twins are one SQL statement each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.spans import row_counts
from ..plans.dialect import DUCK
from ..plans.registry import ask, plan, query, table
from ..plans.tables import written

K1, B = 1.5, 0.75
ABSTAIN, PASS = 4.0, 0.8
FEW = 200_000  # rows of query terms that are broadcast; more are joined by a shuffle


def _few(df: DataFrame) -> DataFrame:
    df = written(df)
    return F.broadcast(df) if df.count() <= FEW else df


def term_counts(texts: DataFrame) -> DataFrame:
    """``(id, term, f, dl)`` of ``texts(id, text)``, written.  Words are counted within their row;
    only rows whose id occurs again are brought together."""
    rows = written(row_counts(texts))
    again = written(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not again.take(1):
        return rows
    same = F.col("id").eqNullSafe(F.col("again"))
    again = again.withColumnRenamed("id", "again")
    many = rows.join(again, same, "left_semi").groupBy("id", "term").agg(F.sum("f").alias("f"))
    lengths = many.groupBy(F.col("id").alias("again")).agg(F.sum("f").alias("dl"))
    return written(rows.join(again, same, "left_anti").unionByName(many.join(lengths, same).select("id", "term", "f", "dl")))


@dataclass
class Index:
    """``texts(id, text)`` and ``postings(term, id, f, dl)``, the number of texts and their mean length."""

    texts: DataFrame
    postings: DataFrame
    n: int
    mean: float

    @classmethod
    def build(cls, texts: DataFrame) -> Index:
        """Of ``texts(id, text)``; texts without a token count for the mean length."""
        counts = term_counts(texts)
        tokens = counts.agg(F.sum("f")).first()[0] or 0
        n = texts.count()
        return cls(texts, counts.where("id IS NOT NULL").select("term", "id", "f", "dl"), n, tokens / n if n else 0.0)

    def save(self, path: str) -> None:
        """Postings by term, so that a search reads the row groups of its terms."""
        self.postings.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.texts.write.mode("overwrite").parquet(f"{path}/texts")
        self.texts.sparkSession.createDataFrame([(self.n, self.mean)], "n long, mean double").write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        stats = spark.read.parquet(f"{path}/stats").first()
        return cls(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/postings"), stats["n"], stats["mean"])

    def idf(self) -> DataFrame:
        """``(term, d, idf)``."""
        return self.postings.groupBy("term").agg(F.count("*").alias("d")).withColumn("idf", F.log(1 + (self.n - F.col("d") + 0.5) / (F.col("d") + 0.5)))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """``(query_id, rank, id, score)``: the best ``k`` texts of each of ``queries(query_id, q)``
        with a score above 0, ties to the smaller id; repeated words count repeatedly."""
        spark = queries.sparkSession
        asked = ask(spark, lambda d: t.term_counts(d, "queries", "query_id", "q"), queries=queries.select("query_id", "q"))
        asked = _few(asked.withColumnRenamed("f", "qf"))
        own = self.postings.join(asked, "term")
        weights = _few(self.idf().join(asked.select("term").distinct(), "term", "left_semi").select("term", "idf"))
        part = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(self.mean or 1.0)))
        scored = own.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qf") * F.col("idf") * part), 6).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0)).select("query_id", "rank", "id", "score")

    def answer(self, queries: DataFrame, k: int = 5, threshold: float = ABSTAIN) -> DataFrame:
        """Every query with its best text, the score (0 without a hit) and whether to abstain."""
        best = self.search(queries, 1).select("query_id", "id", "score")
        out = queries.select("query_id").join(best, "query_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return out.withColumn("abstain", F.col("score") < threshold)

    def evaluate(self, cases: DataFrame, k: int = 5) -> Evaluation:
        """Of ``cases(query_id, q, expect)``; without ``expect`` a case is out of scope."""
        cases = written(cases.select("query_id", "q", F.nullif("expect", F.lit("")).alias("expect")))
        hits = written(self.search(cases, k))
        seen = hits.join(self.texts.select("id", "text"), "id").join(cases.where("expect IS NOT NULL").select("query_id", "expect"), "query_id")
        first = seen.groupBy("query_id").agg(F.min(F.when(F.contains("text", "expect"), F.col("rank"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
        return Evaluation(cases, hits, written(cases.where("expect IS NOT NULL").select("query_id").join(first, "query_id", "left")))


@dataclass
class Evaluation:
    """Cases, their hits, and for those in scope the first relevant rank and the top score."""

    cases: DataFrame
    hits: DataFrame
    ranks: DataFrame

    def report(self) -> DataFrame:
        share = lambda k: F.sum(F.when(F.col("first") <= k, 1).otherwise(0)) / F.greatest(F.lit(1), F.count("*"))
        return self.ranks.agg(F.count("*").alias("in_scope"), *[F.coalesce(F.round(share(k), 3), F.lit(0.0)).alias(f"hit_{k}") for k in (1, 3, 5)], F.coalesce(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 3), F.lit(0.0)).alias("mrr"),
                              F.round(F.min("top"), 2).alias("min_top_score"), F.coalesce(share(3) >= PASS, F.lit(False)).alias("passed"))

    def misses(self) -> DataFrame:
        """Cases found nowhere among the hits, with their best three."""
        missed = self.ranks.where("first IS NULL").select("query_id")
        return missed.join(self.hits.where("rank <= 3"), "query_id", "left").select("query_id", "rank", "id", F.round("score", 2).alias("score"))

    def out_of_scope(self) -> DataFrame:
        best = self.hits.where("rank = 1").select("query_id", "score")
        return self.cases.where("expect IS NULL").select("query_id").join(best, "query_id", "left").select("query_id", F.round(F.coalesce("score", F.lit(0.0)), 2).alias("top_score"))


def contained(items: DataFrame, texts: DataFrame, words: int = 4) -> DataFrame:
    """The ids of ``items(query_id, q)`` whose text stands in one of ``texts(id, text)``.

    Inner words of an item stand whole in any text that holds it, so a hash of up to ``words`` of
    them, from the second on, is an equi-join's key; an item of two words or fewer is found by its
    first three characters.  Only ids travel to that join; the texts that are met are fetched
    after it, and ``contains`` decides.  Items of one or two characters in all are few, however
    many rows they have: each is one of a written list of distinct ones."""
    cut = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    gram = lambda arr, at, n: F.xxhash64(F.array_join(F.slice(arr, at, n), " "))
    inner = F.least(F.lit(words), F.size("w") - 2)
    key = F.when(F.size("w") > 2, gram(F.col("w"), F.lit(2), inner)).when(F.length("q") >= 3, F.xxhash64(F.substr("q", F.lit(1), F.lit(3))))
    items = written(items.where("q IS NOT NULL").select("query_id", "q").withColumn("w", cut(F.col("q"))).withColumn("kind", F.when(F.size("w") > 2, inner).when(F.length("q") >= 3, 0)).withColumn("key", key).drop("w"))
    kinds = [r["kind"] for r in items.where("kind IS NOT NULL").select("kind").distinct().collect()]  # at most words + 1

    def held(n: int):
        """All keys of one kind that a text holds."""
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: gram(F.col("w"), i, F.lit(n)))
        if not n:
            whole = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 2)), lambda i: F.xxhash64(F.substr("text", i, F.lit(3))))
        return F.transform(F.array_distinct(whole), lambda k: F.struct(F.lit(n).alias("kind"), k.alias("key")))

    keys = [F.array().cast("array<struct<kind:int,key:bigint>>"), *map(held, kinds)]
    found = texts.where("text IS NOT NULL").withColumn("w", cut(F.col("text"))).select("id", F.inline(F.concat(*keys)))
    wanted = _few(items.where("kind IS NOT NULL").select("kind", "key", "query_id"))
    met = found.join(wanted, ["kind", "key"]).select("id", "query_id").distinct()
    long = met.join(items.select("query_id", "q"), "query_id").join(texts.select("id", "text"), "id").where(F.contains("text", "q")).select("query_id").distinct()
    tiny = items.where("kind IS NULL AND q <> ''")
    said = written(tiny.select("q").distinct())
    if not said.take(1):
        return long
    seen = texts.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text"))), lambda i: F.array(F.substr("text", i, F.lit(1)), F.substr("text", i, F.lit(2))))))).alias("q"))
    return long.unionByName(tiny.join(seen.join(said, "q", "left_semi").distinct(), "q").select("query_id")).distinct()


def corpus(d, table="documents", key="doc_id") -> str:
    """CTEs: tokens, tf, dl, stats and idf of a table's texts."""
    return f"""tokens AS ({t.tokens(d, table, key)}),
tf AS (SELECT {key}, term, count(*) AS f FROM tokens GROUP BY {key}, term),
dl AS (SELECT c.{key}, coalesce(l.n, 0) AS dl FROM {table} c LEFT JOIN (SELECT {key}, sum(f) AS n FROM tf GROUP BY {key}) l ON c.{key} = l.{key}),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, coalesce(avg(CAST(dl AS DOUBLE)), 0e0) AS avgdl FROM dl),
idf AS (SELECT term, d, ln(1e0 + (n - d + 0.5e0) / (d + 0.5e0)) AS idf FROM (SELECT term, count(*) AS d FROM tf GROUP BY term) x CROSS JOIN stats)"""


def bm25(d, k: int = 5) -> str:
    """CTEs up to ``hits(query_id, doc_id, score, rank)`` for the benchmark texts as queries."""
    return f"""WITH {corpus(d)},
qtokens AS ({t.tokens(d, "benchmark", "item_id")}),
qt AS (SELECT item_id, term, count(*) AS qf FROM qtokens GROUP BY item_id, term),
scored AS (SELECT q.item_id AS query_id, tf.doc_id, round(sum(q.qf * i.idf * tf.f * {K1 + 1}e0 / (tf.f + {K1}e0 * ({1 - B}e0 + {B}e0 * dl.dl / CASE WHEN s.avgdl = 0 THEN 1 ELSE s.avgdl END))), 6) AS score
  FROM qt q JOIN tf ON q.term = tf.term JOIN idf i ON tf.term = i.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN stats s GROUP BY q.item_id, tf.doc_id),
hits AS (SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored) x WHERE rank <= {k} AND score > 0)"""


def evaluation(d) -> str:
    """CTEs up to ``ranks(query_id, first)``: an item is in scope if a document holds its text."""
    return f"""{bm25(d)},
truth AS (SELECT b.item_id, max(CASE WHEN contains(c.text, b.text) THEN 1 ELSE 0 END) AS inside FROM benchmark b CROSS JOIN documents c GROUP BY b.item_id),
ranks AS (SELECT t.item_id AS query_id, min(CASE WHEN contains(c.text, b.text) THEN h.rank END) AS first, max(CASE WHEN h.rank = 1 THEN h.score END) AS top
  FROM truth t JOIN benchmark b ON t.item_id = b.item_id LEFT JOIN hits h ON h.query_id = t.item_id LEFT JOIN documents c ON c.doc_id = h.doc_id WHERE t.inside = 1 GROUP BY t.item_id)"""


def _token_stats(d):
    return f"WITH tokens AS ({t.tokens(d, 'documents', 'doc_id')}) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, CAST(sum(length(term)) AS BIGINT) AS n_letters FROM tokens GROUP BY doc_id"


@plan(_token_stats)
def tokenize_stats(spark, sf_dir):
    counts = term_counts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return counts.groupBy(F.col("id").alias("doc_id")).agg(F.sum("f").alias("n_tokens"), F.count("*").alias("n_terms"), F.sum(F.col("f") * F.length("term")).alias("n_letters"))


@query
def camel_split_tokens(d):
    name = "replace(initcap(p_name), ' ', '')" if d.name == "spark" else "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '')"
    return f"WITH named AS (SELECT p_partkey, {name} AS text FROM part), tokens AS ({t.tokens(d, 'named', 'p_partkey')}) SELECT term, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM tokens GROUP BY term"


@query
def suffix_fold_vocab(d):
    return f"SELECT w AS word, {t.fold(d, 'w')} AS folded, n FROM (SELECT lower(r) AS w, count(*) AS n FROM (SELECT {d.each(t.raw_words(d, 'text'))} AS r FROM benchmark) x GROUP BY lower(r)) y"


def _most_frequent(d):
    return f"WITH tokens AS ({t.tokens(d, 'documents', 'doc_id')}) SELECT doc_id, term, f, place FROM (SELECT doc_id, term, f, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, term) AS INT) AS place FROM (SELECT doc_id, term, count(*) AS f FROM tokens GROUP BY doc_id, term) x) y WHERE place <= 3"


@plan(_most_frequent)
def term_frequency_top(spark, sf_dir):
    """The three most frequent terms of each text."""
    counts = term_counts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("f"), "term"))
    return counts.withColumn("place", place).where("place <= 3").select(F.col("id").alias("doc_id"), "term", "f", "place")


def _documents(spark, sf_dir) -> Index:
    return Index.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def _evaluated(spark, sf_dir) -> Evaluation:
    """Benchmark items as cases: in scope, and expected whole, where a document holds them."""
    index, items = _documents(spark, sf_dir), _queries(spark, sf_dir)
    inside = contained(items, index.texts).withColumn("inside", F.lit(True))
    return index.evaluate(items.join(inside, "query_id", "left").select("query_id", "q", F.when(F.col("inside"), F.col("q")).alias("expect")))


@plan(f"WITH {corpus(DUCK)} SELECT term, d AS n_docs FROM idf")
def document_frequency(spark, sf_dir):
    return _documents(spark, sf_dir).idf().select("term", F.col("d").alias("n_docs"))


@plan(f"WITH {corpus(DUCK)} SELECT term, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf_dir):
    return _documents(spark, sf_dir).idf().select("term", F.round("idf", 6).alias("idf"))


@plan(f"WITH {corpus(DUCK)}, ranked AS (SELECT dl, row_number() OVER (ORDER BY dl) - 1 AS pos, count(*) OVER () AS n FROM dl) SELECT CAST(max(n) AS BIGINT) AS n_docs, CAST(max(CASE WHEN pos = floor(n / 2) THEN dl END) AS BIGINT) AS upper_median, CAST(max(dl) AS BIGINT) AS longest, round(avg(CAST(dl AS DOUBLE)), 6) AS avgdl FROM ranked")
def doc_length_stats(spark, sf_dir):
    """Texts, upper median, longest and mean length; texts are counted by length first."""
    index = _documents(spark, sf_dir)
    known = index.postings.select("id", "dl").distinct()
    lengths = index.texts.select("id").join(known, "id", "left").groupBy(F.coalesce("dl", F.lit(0)).alias("dl")).agg(F.count("*").alias("c"))
    upto = lengths.withColumn("upto", F.sum("c").over(Window.orderBy("dl")))
    return upto.agg(F.sum("c").alias("n_docs"), F.min(F.when(F.col("upto") > index.n // 2, F.col("dl"))).alias("upper_median"), F.max("dl").alias("longest"), F.round(F.sum(F.col("dl") * F.col("c")) / F.sum("c"), 6).alias("avgdl"))


@plan(f"{bm25(DUCK)} SELECT query_id, rank, doc_id, score FROM hits")
def bm25_top5(spark, sf_dir):
    return _documents(spark, sf_dir).search(_queries(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@F.udf
def _two_places(score):
    """As C's printf: the double's exact value decides, where Java rounds its shortest decimal form up."""
    return None if score is None else f"{score:6.2f}"


def printed(hits: DataFrame, texts: DataFrame, width: int = 110) -> DataFrame:
    """``(query_id, rank, line)``: hits as lines to print, with the score to two places, the id, the
    heading (where ``texts`` has one) and below them the beginning of the text's first line."""
    first = F.substr(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], F.lit(1), F.lit(width))
    heading = F.coalesce("heading", F.lit("")) if "heading" in texts.columns else F.lit("")
    own = texts.select("id", heading.alias("heading"), first.alias("first"))
    line = F.concat(_two_places("score"), F.lit("  ["), F.col("id").cast("string"), F.lit("]  "), F.col("heading"), F.lit("\n        "), F.col("first"))
    return hits.join(own, "id").select("query_id", "rank", line.alias("line"))


@plan(f"{bm25(DUCK)} SELECT h.query_id, h.rank, printf('%6.2f', h.score) || '  [' || h.doc_id || ']  ' || chr(10) || '        ' || substr(string_split(coalesce(c.text, ''), chr(10))[1], 1, 110) AS line FROM hits h JOIN documents c ON c.doc_id = h.doc_id")
def printed_hits(spark, sf_dir):
    """The rows of ``bm25_top5`` as lines to print."""
    index = _documents(spark, sf_dir)
    return printed(index.search(_queries(spark, sf_dir)), index.texts)


@plan(f"{bm25(DUCK, 1)} SELECT b.item_id AS query_id, h.doc_id, coalesce(h.score, 0e0) AS score, coalesce(h.score, 0e0) < 40e0 AS abstain FROM benchmark b LEFT JOIN hits h ON b.item_id = h.query_id")
def bm25_abstain(spark, sf_dir):
    return _documents(spark, sf_dir).answer(_queries(spark, sf_dir), threshold=40.0).withColumnRenamed("id", "doc_id")


@plan(f"{evaluation(DUCK)} SELECT CAST(count(*) AS BIGINT) AS in_scope, " + ", ".join(f"round(CAST(sum(CASE WHEN first <= {k} THEN 1 ELSE 0 END) AS DOUBLE) / greatest(1, count(*)), 3) AS hit_{k}" for k in (1, 3, 5)) + ", coalesce(CAST(sum(CASE WHEN first <= 3 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(1, count(*)) >= 0.8e0, false) AS passed FROM ranks")
def eval_hit_at_k(spark, sf_dir):
    return _evaluated(spark, sf_dir).report().select("in_scope", "hit_1", "hit_3", "hit_5", "passed")


@plan(f"{evaluation(DUCK)} SELECT round(avg(coalesce(1e0 / first, 0e0)), 3) AS mrr, round(min(top), 2) AS min_top_score FROM ranks")
def eval_mrr(spark, sf_dir):
    return _evaluated(spark, sf_dir).report().select("mrr", "min_top_score")


@plan(f"{evaluation(DUCK)} SELECT r.query_id, h.rank, h.doc_id, round(h.score, 2) AS score FROM ranks r LEFT JOIN hits h ON h.query_id = r.query_id AND h.rank <= 3 WHERE r.first IS NULL")
def eval_misses(spark, sf_dir):
    return _evaluated(spark, sf_dir).misses().withColumnRenamed("id", "doc_id")


@plan(f"{evaluation(DUCK)} SELECT t.item_id AS query_id, round(coalesce(max(h.score), 0e0), 2) AS top_score FROM truth t LEFT JOIN hits h ON h.query_id = t.item_id AND h.rank = 1 WHERE t.inside = 0 GROUP BY t.item_id")
def eval_out_of_scope_floor(spark, sf_dir):
    return _evaluated(spark, sf_dir).out_of_scope()


def _first_tenth() -> str:
    return "SELECT item_id, 'which ' || substr(text, 1, 30) AS q, CASE WHEN item_id % 4 = 0 THEN NULL ELSE substr(text, 40, 12) END AS expect FROM benchmark"


@plan(f"""WITH {corpus(DUCK)}, cases AS ({_first_tenth()}), qtokens AS ({t.tokens(DUCK, "cases", "item_id", "q")}), qt AS (SELECT item_id, term, count(*) AS qf FROM qtokens GROUP BY item_id, term),
scored AS (SELECT q.item_id, tf.doc_id, round(sum(q.qf * i.idf * tf.f * 2.5e0 / (tf.f + 1.5e0 * (0.25e0 + 0.75e0 * dl.dl / s.avgdl))), 6) AS score FROM qt q JOIN tf ON q.term = tf.term JOIN idf i ON tf.term = i.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN stats s GROUP BY q.item_id, tf.doc_id),
hits AS (SELECT item_id, doc_id, score, rank FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) x WHERE rank <= 5),
found AS (SELECT h.item_id, min(h.rank) AS first FROM hits h JOIN documents c ON c.doc_id = h.doc_id JOIN cases k ON k.item_id = h.item_id WHERE contains(c.text, k.expect) GROUP BY h.item_id)
SELECT k.item_id AS query_id, CAST(h.rank AS INT) AS rank, h.doc_id, round(h.score, 2) AS score FROM cases k LEFT JOIN found f ON f.item_id = k.item_id LEFT JOIN hits h ON h.item_id = k.item_id AND h.rank <= 3 WHERE k.expect <> '' AND f.first IS NULL""")
def eval_partial_misses(spark, sf_dir):
    """Cases that ask with an item's beginning and expect a later part of it: those found nowhere."""
    cases = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "'which ' || substr(text, 1, 30) AS q", "CASE WHEN item_id % 4 = 0 THEN NULL ELSE substr(text, 40, 12) END AS expect")
    return _documents(spark, sf_dir).evaluate(cases).misses().withColumnRenamed("id", "doc_id")
