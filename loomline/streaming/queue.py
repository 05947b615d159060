"""The index queue as a stream with state: pending jobs per project outlive micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import ship

#: The store that keeps map states and timers; a session needs it before the stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Queue(StatefulProcessor):
    def __init__(self, size: int, ticks: int, wait_ms: int):
        self.size, self.ticks, self.wait_ms = size, ticks, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "priority string, reason string, seq long, queued_at long")
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples():  # rows of a micro-batch come in any order
                old = self.pending.getValue((r.path,)) if self.pending.containsKey((r.path,)) else None
                if old is None or (r.priority == "HIGH", r.seq) > (old[0] == "HIGH", old[2]):
                    self.pending.updateValue((r.path,), (r.priority, r.reason, int(r.seq), int(r.queued_at)))
        self._wake(timerValues.getCurrentProcessingTimeInMs())
        yield from ()

    def _wake(self, now: int) -> None:
        due = now + self.wait_ms
        if not any(t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs = sorted(((v[0] != "HIGH", v[3], k[0], v) for k, v in self.pending.iterator()))
        n = self.taken.get()[0] if self.taken.exists() else 0
        now, out = jobs[: self.size * self.ticks], []
        for i, (_, _, path, v) in enumerate(now):
            self.pending.removeKey((path,))
            out.append((key[0], n + i // self.size, path, *v))
        if now:
            self.taken.update((n + -(-len(now) // self.size),))
            yield pd.DataFrame(out, columns=["project", "batch", "path", "priority", "reason", "seq", "queued_at"])
        if len(jobs) > len(now):  # the timer that has just expired is still listed
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def close(self) -> None:
        pass


def drained(jobs: DataFrame, size: int = 6, batches: int = 16, wait_ms: int = 120) -> DataFrame:
    """(project, batch, path, priority, reason, seq, queued_at): the jobs of a stream (project, path, priority, reason, seq, queued_at) as they are due.

    A job waits in its project's state, one per path: a HIGH job is never replaced by a LOW one, in whatever micro-batch either comes,
    else the newest wins. ``wait_ms`` after jobs came, and as long as some are left, up to ``batches`` batches of ``size`` jobs leave: HIGH
    first, then first come, then by path. batch counts a project's batches from 0, over restarts too. A project's pending jobs are one task's state; projects are spread.
    """
    spark = jobs.sparkSession
    ship(spark)
    name = jobs.schema["project"].dataType.simpleString()
    rows = jobs.select("project", "path", "priority", "reason", "seq", "queued_at")
    out = f"project {name}, batch long, path string, priority string, reason string, seq long, queued_at long"
    return rows.groupBy("project").transformWithStateInPandas(_Queue(size, batches, wait_ms), out, "append", "processingTime")


def with_reason(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with their reason by what is there now: CHANGED if the path is among the sources (path), else DELETED."""
    there = sources.select("path").distinct().withColumn("there", F.lit(True))
    return jobs.drop("reason").join(there, "path", "left").withColumn("reason", F.when(F.col("there"), "CHANGED").otherwise("DELETED")).drop("there")


def attempted(jobs: DataFrame, work: Callable[[str], str]) -> DataFrame:
    """(path, result, error) of each job (path): one that fails is set aside with its error, the others of its batch go on."""
    ship(jobs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path in part["path"]:
                try:
                    out.append((path, work(path), None))
                except Exception as e:  # noqa: BLE001  whatever a job raises is its own row's error
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "result", "error"])

    return jobs.select("path").mapInPandas(run, "path string, result string, error string")
