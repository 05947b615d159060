"""File changes as a stream: debounce, queue, versioned upserts; and running request counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.index import queued
from ..sources.files import SKIPPED
from ..sources.store import Change, Store


def watched(events: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Changes of sources outside skipped folders: the same rule as a scan has."""
    return events.filter(F.col("path").rlike(r"\.tsx?$") & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skipped])))


def debounced(events: DataFrame, quiet: str = "300 milliseconds", late: str = "10 seconds", feed: Column | None = None) -> DataFrame:
    """(feed, paths, from, to): distinct paths of each burst of (ts, path) that ``quiet`` ends, per feed (a project, say; else all are one).

    ts may be without time zone; watermarks need one.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    burst = F.session_window("ts", quiet)
    one = F.substring("path", 1, 0)  # sessions need a key that isn't constant
    return timed.groupBy((one if feed is None else feed).alias("feed"), burst).agg(F.collect_set("path").alias("paths")).select("feed", "paths", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"))


def as_jobs(bursts: DataFrame) -> DataFrame:
    """One HIGH job per path of a burst."""
    return bursts.select(F.explode("paths").alias("path"), F.lit("HIGH").alias("priority"), F.unix_millis("to").alias("seq"), F.unix_millis("to").alias("queued_at"))


def running_stats(requests: DataFrame) -> DataFrame:
    """Counters since the start, for complete or update mode."""
    return requests.groupBy().agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.sum("latency_ms").alias("latency_ms"), F.sum(F.greatest(F.lit(0), F.col("tokens_raw") - F.col("tokens_after"))).alias("tokens_removed"))


def per_window(requests: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and mean latency per window of event time; late rows count until the watermark passes."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms"))


def query_id(spark: SparkSession) -> str | None:
    """The id of the streaming query whose micro-batch runs here: it stays over restarts on one checkpoint, another checkpoint has another."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def upserting(jobs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "120 milliseconds") -> DataStreamWriter:
    """A sink that hands each micro-batch's queue, one job per path, to ``handle(queue, batch number)``. A batch may come again after a failure: handlers tell by query and batch number."""
    return jobs.writeStream.foreachBatch(lambda df, n: handle(queued(df), n)).option("checkpointLocation", checkpoint).trigger(processingTime=trigger)


def versions(spark: SparkSession, root: str) -> list[tuple[int, str, int, str]]:
    """(place, query, batch number, folder) of every version written below ``root``, in order. No log means that there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(map(tuple, spark.read.schema("place long, query string, batch long, folder string").json(f"{root}/log").fillna("", "query").collect()))  # a row per version


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version."""
    found = versions(spark, root)
    return spark.read.parquet(f"{root}/{found[-1][-1]}") if found else None


def versioned(root: str, key: str, newest: Sequence[str] = ()) -> Callable[..., None]:
    """A handler that upserts rows into a new version of a table, and logs it with its query and batch when it is whole.

    The base is always the newest logged version. A batch that the log holds under the same query was written whole and is
    passed over; a new checkpoint is another query, so its batches count anew and lose nothing. Outside a stream, where no query
    is known or given, every call is applied. A null key is a key like others. Of several rows of a key in a batch the one
    with the greatest ``newest`` columns stays. Every batch writes the table once: ``sources.store`` writes what changed only.
    """

    def handle(rows: DataFrame, n: int, query: str | None = None) -> None:
        spark = rows.sparkSession
        query = query or query_id(spark) or ""
        found = versions(spark, root)
        if query and any((q, b) == (query, n) for _, q, b, _ in found):
            return
        one = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*newest, *[c for c in rows.columns if c not in newest])).alias("r")).select("r.*")
        place = found[-1][0] + 1 if found else 0
        folder = f"v{place}-{uuid.uuid4().hex[:8]}"
        keys = rows.select(F.col(key).alias("__key")).distinct()
        out = one if not found else spark.read.schema(rows.schema).parquet(f"{root}/{found[-1][-1]}").join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti").select(*rows.columns).unionByName(one)
        out.write.parquet(f"{root}/{folder}")
        spark.createDataFrame([(place, query, n, folder)], "place long, query string, batch long, folder string").coalesce(1).write.mode("append").json(f"{root}/log")

    return handle


def into(store: Store, table: str) -> Callable[[DataFrame, int], None]:
    """A handler that commits each batch's rows to a table of a store: it writes the batch, not the table, and tells batches that come again."""
    return lambda rows, n: store.apply({table: Change(rows)}, query_id(rows.sparkSession), n)


def followed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the log files of a folder as they come: (line, file). Empty lines are left out, as a reader of the last lines does."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"), F.input_file_name().alias("file")).filter("trim(line) != ''")
