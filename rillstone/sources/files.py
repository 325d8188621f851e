"""Readers and writers: Markdown folders, JSON indexes, registries, TSV lessons, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINGERPRINT = ("app string, root string, bundle string, types array<string>, files array<string>, has_metadata boolean, "
               "keywords array<string>, privacy string, first_sentence string, review_note_chars int, has_support_url boolean")
CHUNK = "id string, source string, heading string, text string"
CASE = "q string, expect string, note string"


def markdown_lines(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``(doc, pos, line)`` of a folder's files, not recursive; ``doc`` is the file name."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("doc"), F.regexp_replace("value", "\n$", "").alias("value"))
    return files.select("doc", F.posexplode(F.split("value", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)).alias("pos", "line"))


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases; an empty or missing ``expect`` is out of scope."""
    return spark.read.schema(CASE).json(path, multiLine=True).withColumn("in_scope", F.coalesce("expect", F.lit("")) != "")


def registry(spark: SparkSession, path: str, exclude: str = "") -> DataFrame:
    """Fingerprints, one JSON file each; malformed ones are skipped, one app can be left out."""
    rows = spark.read.schema(FINGERPRINT).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    return rows.where(F.col("app").isNotNull() & (F.lower("app") != exclude.lower()))


def lessons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("job string, lesson string").csv(path, sep="\t")


def register(prints: DataFrame, path: str) -> None:
    """Upsert by app: only the partitions of the given apps are replaced."""
    prints.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app").parquet(path)


def chunks(spark: SparkSession, path: str, pattern: str = "*.md", least: int = 40) -> DataFrame:
    """``(id, source, heading, text, n)`` of a folder's Markdown files."""
    from ..operators.ingest import chunk_markdown

    return chunk_markdown(spark, markdown_lines(spark, path, pattern), least)


def build_index(spark: SparkSession, folder: str, out: str, least: int = 40):
    """Chunk a folder, write the chunks as JSON and the search index beside them."""
    from ..operators.retrieval import Index
    from ..plans.tables import written

    made = written(chunks(spark, folder, least=least))
    made.select("id", "source", "heading", "text").write.mode("overwrite").json(f"{out}/chunks")
    index = Index.build(made.select("id", F.concat_ws("\n", "heading", "text").alias("text")))
    index.save(out)
    return index


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``(root, path, text)`` of the projects below a folder: all text files, by project folder;
    bytes that aren't UTF-8 are replaced."""
    base = F.lit(root.rstrip("/").removeprefix("file://"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{swift,md,txt,pbxproj,kt}").load(root)
    path = F.substr(F.regexp_replace("path", "^[a-z]+:/+", "/"), F.length(base) + 2)
    return read.select(F.concat(base, F.lit("/"), F.regexp_extract(path, "^([^/]+)/", 1)).alias("root"), F.regexp_extract(path, "^[^/]+/(.*)$", 1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def project_root(files: DataFrame, starts: DataFrame) -> DataFrame:
    """``(path, root)``: the folder itself where it holds a project file, else its parent where that does."""
    holds = files.where(F.col("path").rlike("^[^/]+[.]xcodeproj/")).select("root").distinct()
    own = starts.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"))
    out = own.join(holds.select(F.col("root").alias("path"), F.lit(True).alias("self")), "path", "left").join(holds.select(F.col("root").alias("parent"), F.lit(True).alias("above")), "parent", "left")
    return out.select("path", F.when(F.col("self").isNull() & F.col("above"), F.col("parent")).otherwise(F.col("path")).alias("root"))


def settings(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines (the first of a key wins) over the defaults; a handful of rows."""
    pair = spark.read.text(path).select(F.regexp_extract("value", "^([^=#]+)=(.*)$", 1).alias("k"), F.regexp_extract("value", "^([^=#]+)=(.*)$", 2).alias("v"), F.monotonically_increasing_id().alias("n")).where("k <> ''")
    rows = pair.groupBy("k").agg(F.min_by("v", "n").alias("v")).collect()
    return {**(defaults or {}), **{r["k"]: r["v"] for r in rows if r["v"]}}


def append_log(lines: DataFrame, path: str) -> None:
    """Append ``(time, line)`` to a log folder."""
    lines.select("time", "line").write.mode("append").json(path)


def tail(spark: SparkSession, path: str, n: int = 12) -> DataFrame:
    """The last lines of a log folder, oldest first."""
    log = spark.read.schema("time timestamp, line string").json(path)
    return log.orderBy(F.desc("time"), F.desc("line")).limit(n).orderBy("time", "line")


def snapshot(files: DataFrame, path: str, stage: str | None = None) -> None:
    """Write the files as the new snapshot, or as the snapshot of a stage beside earlier ones."""
    files.write.mode("overwrite").parquet(path if stage is None else f"{path}/stage={stage}")


def spill(texts: DataFrame, path: str) -> None:
    """Write long texts ``(path, text)``; line breaks inside them stay."""
    texts.write.mode("append").json(path)


def newer(done: float | None, source: float) -> bool:
    """Whether a day's source was written after what was made of it."""
    return done is None or source > done
