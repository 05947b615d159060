"""The manifest of indexed files as versions of a Parquet table, with reading of the older JSON form."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, mtime double, size long, hash string, ast_version int, rag_version int, ast_chunk string"
#: The one version of the JSON form that is read (fixed value).
LEGACY_VERSION = 1
_META = "struct<mtime:double,size:bigint,hash:string,astVersion:int,ragVersion:int,astChunk:string>"


class Manifest:
    """A folder of versions and a pointer to the current one: a write never touches the version that is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self) -> str | None:
        try:
            row = self.spark.read.schema("version string, at long").json(f"{self.root}/current").orderBy(F.desc("at")).first()
        except AnalysisException:
            return None
        return row["version"] if row else None

    def load(self, legacy: str | None = None) -> DataFrame:
        """Rows by path; from the JSON form if there is no table yet (which is then written); else none."""
        version = self._current()
        if version:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{version}").orderBy("path")
        if legacy:
            rows = read_legacy(self.spark, legacy)
            if not rows.isEmpty():
                self.save(rows)
                return self.load()
        return self.spark.createDataFrame([], SCHEMA)

    def migrate(self, legacy: str) -> bool:
        """Take over the JSON form and remove its file: only if there is no table yet and the file has entries; the file goes once all its paths are in the table."""
        if self._current():
            return False
        rows = read_legacy(self.spark, legacy)
        if rows.isEmpty():
            return False
        self.save(rows)
        if self.load().count() != rows.select("path").distinct().count():
            raise RuntimeError(f"{legacy} stays: the table hasn't all its rows")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(legacy)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)

    def save(self, rows: DataFrame) -> None:
        """Replace all rows; of several of a path the one with the newest mtime stays (one without mtime last, ties by size and hash)."""
        version = f"v-{uuid.uuid4().hex}"
        kept = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), F.struct("mtime", "size", "hash")).alias("r")).select("r.*")
        kept.write.parquet(f"{self.root}/{version}")
        self.spark.range(1).select(F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("at")).write.mode("append").json(f"{self.root}/current")


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``{"version": 1, "files": {path: meta}}``; another version or text that isn't JSON gives none, entries that are no objects are skipped."""
    try:
        text = spark.read.option("wholetext", "true").text(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    doc = text.select(F.from_json("value", "version int, files map<string,string>").alias("d")).filter(F.col("d.version") == LEGACY_VERSION)
    rows = doc.select(F.explode("d.files").alias("path", "meta")).filter(F.col("meta").startswith("{"))
    m = F.from_json("meta", _META)
    return rows.select("path", m.alias("m")).select("path", "m.mtime", "m.size", "m.hash", F.col("m.astVersion").alias("ast_version"), F.col("m.ragVersion").alias("rag_version"), F.col("m.astChunk").alias("ast_chunk"))


def chunk_text(columns: list[str]):
    """The chunk column of a manifest row: some columns as JSON."""
    return F.to_json(F.struct(*columns)).alias("ast_chunk")


def parsed_chunks(manifest: DataFrame, schema: str) -> DataFrame:
    """Manifest rows with their chunk parsed; rows whose chunk is there but isn't JSON of that schema are dropped."""
    out = manifest.withColumn("chunk", F.from_json("ast_chunk", schema))
    return out.filter(F.col("ast_chunk").isNull() | F.col("chunk").isNotNull())
