"""Queries by name: one plan builder each, run on Spark and rendered for the oracle.

A builder is a function of a dialect that returns SQL over named tables.  ``ask`` runs a
builder over DataFrames of the caller's own; a registered query runs over the tables of a
folder.  Tables are handed to the SQL as arguments, so no view of the session is touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import DUCK, SPARK

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BUILDERS: dict = {}
PLANS: dict = {}
TWINS: dict = {}


def query(build):
    """Register a builder: a function of a dialect that returns SQL."""
    BUILDERS[build.__name__] = build
    return build


def plan(twin: str | Callable):
    """Register a DataFrame plan ``(spark, sf_dir)`` with hand-written SQL (or a builder) as its twin."""

    def kept(make):
        PLANS[make.__name__] = make
        TWINS[make.__name__] = twin if isinstance(twin, str) else twin(DUCK)
        return make

    return kept


def ask(spark: SparkSession, build, *how, **tables: DataFrame) -> DataFrame:
    """The DataFrame of a builder's SQL over the given ``tables``."""
    return over(spark, build(SPARK, *how), tables)


def over(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    for name in tables:
        sql = re.sub(rf"(?<![\w.])(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    named = {name: table for name, table in tables.items() if f"{{{name}}}" in sql}
    if not named:
        return spark.sql(sql)
    # Other braces (of patterns) are text.
    marks = {name: f"@{name}@" for name in named}
    for name, mark in marks.items():
        sql = sql.replace(f"{{{name}}}", mark)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name, mark in marks.items():
        sql = sql.replace(mark, f"{{{name}}}")
    return spark.sql(sql, **named)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The DataFrame of ``sql`` over the tables it names."""
    return over(spark, sql, {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)})


def spark_queries() -> dict:
    return {name: (lambda spark, sf_dir, build=build: run(spark, sf_dir, build(SPARK))) for name, build in BUILDERS.items()} | PLANS


def oracle_queries() -> dict[str, str]:
    return {name: build(DUCK) for name, build in BUILDERS.items()} | TWINS
