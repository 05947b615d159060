import random
import time

import pytest

from loomline.operators import index
from loomline.streaming import queue

SCHEMA = "project string, path string, priority string, reason string, seq long, queued_at long"


@pytest.fixture
def provider(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_pending_jobs_outlive_a_restart(spark, tmp_path, provider):
    """Two runs on one checkpoint; nothing is due in the first. What leaves in the second is the fold over the jobs of both."""
    rng = random.Random(3)
    rows = [("p" if i % 3 else "q", f"f{rng.randrange(14)}.ts", rng.choice(["HIGH", "LOW", "LOW"]), "CHANGED", i, 1000 + rng.randrange(50)) for i in range(60)]
    out, path = [], f"{tmp_path}/jobs"
    for part, wait in ((rows[:40], 3_600_000), (rows[40:], 50)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        feed = queue.drained(spark.readStream.schema(SCHEMA).parquet(path), batches=2, wait_ms=wait)
        q = feed.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="100 milliseconds").start()
        want = {} if wait > 1000 else {p: index.batches(index.queued(spark.createDataFrame([r for r in rows if r[0] == p], SCHEMA).drop("project"))).orderBy("place").collect() for p in "pq"}
        end = time.time() + 90
        while time.time() < end and (len(out) < sum(map(len, want.values())) or q.lastProgress is None or not any(x["numInputRows"] for x in q.recentProgress)):
            assert q.isActive, q.exception()
            time.sleep(0.2)
        q.stop()
        if not want:
            assert not out
    assert len(out) == sum(map(len, want.values()))
    for p in "pq":
        assert [(r.batch, r.path, r.priority, r.seq) for r in sorted((r for r in out if r.project == p), key=lambda r: (r.batch, r.priority, r.queued_at, r.path))] == [(r.batch, r.path, r.priority, r.seq) for r in want[p]]


def test_reasons_and_failing_jobs(spark):
    jobs = spark.createDataFrame([("a",), ("bad",), ("gone",)], "path string")
    assert {(r.path, r.reason) for r in queue.with_reason(jobs, spark.createDataFrame([("a",), ("a",), ("bad",)], "path string")).collect()} == {("a", "CHANGED"), ("bad", "CHANGED"), ("gone", "DELETED")}

    def work(path):
        if path == "bad":
            raise ValueError("no")
        return path.upper()

    assert {tuple(r) for r in queue.attempted(jobs, work).collect()} == {("a", "A", None), ("bad", None, "ValueError: no"), ("gone", "GONE", None)}
