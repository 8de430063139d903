"""The chunk store: a parquet table by method, with upserts, snapshots, statistics."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sequence import upserted

SCHEMA = "chunk_id string, text string, source_id string, title string, channel string, url string, domain string, method string, difficulty string, embedding array<float>"


#: Megabytes beyond which a snapshot is called large.
LARGE = 100.0


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class ChunkStore:
    """A versioned folder of parquet: each write makes a new version, readers keep the one they opened."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, key: str = "chunk_id", partition: str | None = "method"):
        self.spark, self.path, self.schema, self.key, self.partition = spark, path.rstrip("/"), schema, key, partition

    def _versions(self) -> list[str]:
        fs, p = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith("v") and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        """The latest version; an empty frame of the schema where there is none."""
        v = self._versions()
        if not v:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/{v[-1]}").select(*self.spark.createDataFrame([], self.schema).columns)

    def write(self, df: DataFrame) -> None:
        v = self._versions()
        n = int(v[-1][1:9]) + 1 if v else 0
        w = df.write.mode("overwrite")
        (w.partitionBy(self.partition) if self.partition else w).parquet(f"{self.path}/v{n:08d}")
        for old in v[:-1]:
            delete(self.spark, f"{self.path}/{old}")

    def upsert(self, chunks: DataFrame, replace_sources: bool = False) -> None:
        """Adds or replaces rows by key: the same rows twice change nothing. With replace_sources, what the
        sources of `chunks` had before goes as well."""
        old = self.read()
        if replace_sources:
            old = old.join(chunks.select("source_id").distinct(), "source_id", "left_anti").select(*old.columns)
        self.write(upserted(old, chunks.select(*[c for c in old.columns if c in chunks.columns]), self.key).select(*old.columns))

    def drop(self) -> None:
        delete(self.spark, self.path)

    def export(self, path: str) -> float:
        """A snapshot that `restore` reads; returns its megabytes, and warns of more than LARGE."""
        self.read().write.mode("overwrite").parquet(path)
        fs, p = _fs(self.spark, path)
        size = fs.getContentSummary(p).getLength() / 1e6
        if size > LARGE:
            warnings.warn(f"the snapshot {path} holds {size:.0f} MB", stacklevel=2)
        return size

    def restore(self, path: str) -> None:
        if not exists(self.spark, path):
            raise FileNotFoundError(path)
        self.write(self.spark.read.parquet(path))

    def count(self) -> int:
        return self.read().count()

    def where_method(self, methods: list[str]) -> DataFrame:
        """Only the folders of these methods are read."""
        return self.read().where(F.col("method").isin(methods))


def fresh_name(path: str) -> str:
    return f"{path.rstrip('/')}/{uuid.uuid4().hex}"
