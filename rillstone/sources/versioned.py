"""Tables that grow by delta files, with one manifest for each version.

A commit writes its own rows as a new part and then one manifest that lists all parts of the
new version; the manifest appears by a single rename.  Whatever happens before that rename, a
reader sees the version before; whatever happens after it, the one that was committed.  Each
writer numbers its batches, and the manifest holds the last number of each, so a batch that
is handed in again changes nothing.  Parts that no manifest names are left-overs of a crash.

One process commits at a time (a streaming query is the only writer of its table).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import let_go


@dataclass
class Version:
    """The number of a version, its parts and the last batch of each writer."""

    n: int = 0
    parts: list[str] = field(default_factory=list)
    last: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table in the folder ``path`` with rows of ``schema``; for ``distinct`` columns, whose values
    seldom repeat in a file, no dictionary is tried."""

    def __init__(self, spark: SparkSession, path: str, schema: str, distinct: list[str] | None = None):
        self.spark, self.path, self.schema, self.distinct = spark, path.rstrip("/"), schema, distinct or []
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.hadoop.Path("/".join((self.path, *names)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def version(self) -> Version:
        """The newest one; manifests are a few lines each, and older ones go with ``compact``."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        if not names:
            return Version()
        stream = self.fs.open(self._at("versions", names[-1]))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _publish(self, version: Version) -> None:
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(version.__dict__).encode()))
        stream.close()
        self.fs.mkdirs(self._at("versions"))
        final = self._at("versions", f"{version.n:012d}.json")
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"version {version.n} of {self.path} was committed by another writer")

    def read(self, version: Version | None = None) -> DataFrame:
        """All rows of a version, in no order."""
        parts = (version or self.version()).parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/parts").parquet(*[f"{self.path}/{p}" for p in parts])
        return rows.drop("part")

    def commit(self, rows: DataFrame | list[DataFrame], writer: str, batch: int, by: list[str] | None = None) -> bool:
        """Add ``rows`` (or several slices, written one after the other) as batch number ``batch`` of
        ``writer``; False if that batch is there already."""
        before = self.version()
        if batch <= before.last.get(writer, -1):
            return False
        part = f"parts/part=p{uuid.uuid4().hex}"
        for rows_ in rows if isinstance(rows, list) else [rows]:
            self._write(rows_, part, by)
            if isinstance(rows, list):
                let_go(self.spark)
        self._publish(Version(before.n + 1, [*before.parts, part], {**before.last, writer: batch}))
        return True

    def _write(self, rows: DataFrame, part: str, by: list[str] | None) -> None:
        out = rows.write.partitionBy(*by) if by else rows.write
        for c in self.distinct:
            out = out.option(f"parquet.enable.dictionary#{c}", "false")
        out.mode("append").option("compression", "zstd").parquet(f"{self.path}/{part}")

    def compact(self, fold: Callable[[DataFrame], DataFrame], by: list[str] | None = None) -> None:
        """Replace all parts by one with ``fold`` of their rows; drop what is no longer named."""
        before = self.version()
        if len(before.parts) > 1:
            part = f"parts/part=p{uuid.uuid4().hex}"
            self._write(fold(self.read(before)), part, by)
            self._publish(Version(before.n + 1, [part], before.last))
        self.clean()

    def clean(self) -> None:
        """Delete manifests but the newest and parts that it doesn't name."""
        now = self.version()
        kept = {p.split("/")[1] for p in now.parts}
        for name in self._names("parts"):
            if name not in kept:
                self.fs.delete(self._at("parts", name), True)
        for name in self._names("versions"):
            if name != f"{now.n:012d}.json":
                self.fs.delete(self._at("versions", name), True)
        for name in self._names(""):
            if name.startswith("draft-"):
                self.fs.delete(self._at(name), True)


class LatestByKey:
    """The newest row of each key, fed batch by batch: a batch writes its own size.

    ``columns`` holds the columns of the key, of the order and the rest as DDL.  Every
    ``fold_at`` batches the parts are folded into one.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: list[str], order: list[str], fold_at: int = 16):
        self.table, self.key, self.order, self.fold_at = VersionedTable(spark, path, columns), key, order, fold_at

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        best = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("r"))
        return best.select(*[F.col(c) if c in self.key else F.col(f"r.{c}") for c in rows.columns])

    def read(self) -> DataFrame:
        return self._newest(self.table.read())

    def put(self, batch: DataFrame, number: int, writer: str = "stream") -> bool:
        """For ``foreachBatch``: a repeated batch changes nothing."""
        names = self.table.spark.createDataFrame([], self.table.schema).columns
        done = self.table.commit(self._newest(batch.select(*names)), writer, number)
        if done and len(self.table.version().parts) >= self.fold_at:
            self.table.compact(self._newest)
        return done
