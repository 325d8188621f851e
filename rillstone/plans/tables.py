"""Intermediate tables: written as Parquet in a folder that all executors share, and read
back, so that a plan used several times is computed once and survives lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of the warehouse, or, for a local
    session, a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="rillstone-"))


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/k-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if not at.getName().startswith("k-"):
            raise ValueError(f"{at} isn't a written table")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to any more, so that their files go
    before the next step writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
