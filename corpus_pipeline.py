"""The corpus pipeline: language, repeated passages, near copies, benchmark leaks, mixture.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``; each works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from rillstone.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

FEW = 200_000

#: SQL can't express the learned stages; tests compare them with plain loops.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or torn between two languages, go; ``lang`` becomes the prediction."""
    docs = docs.select(*COLUMNS)
    seen = language_id.predict(docs, language_id.fit(docs), gap=0.02)
    return seen.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; a document that keeps less than a
    fifth of its text was a copy and goes."""
    left = line_dedup.line_dedup(docs.select(*COLUMNS))
    kept = F.length(F.trim("text")) * 5 >= F.length("text") + F.col("n_removed_chars")
    return _sized(left.where((F.col("n_removed") == 0) | kept))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at 0.8 or more."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go: each row for its
    own text, whether or not it has an id or shares it."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = F.concat_ws(":", F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1)))
    docs = docs.select(*COLUMNS, row.alias("row_key"))
    found = decontaminate.decontaminate(docs.select("row_key", "text"), benchmark, id_col="row_key")
    hit = settle(found.where(F.size("items") > 0).select(F.col("id").alias("row_key")).distinct())
    few = hit.count() <= FEW  # about 60 bytes each; more are joined by a shuffle
    return docs.join(F.broadcast(hit) if few else hit, "row_key", "left_anti").select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate at which a loader takes each document; a rate of 0 drops it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.label_domains(labels))
    return mixed.where("rate > 0").select(*COLUMNS, "domain", "n_tokens", "rate")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_domains),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
