import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import telemetry
from loomline.streaming import queue, rings

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "gateway string, ts timestamp, id long, ok boolean, latency_ms long, tokens_before long, tokens_after long, reset boolean"


@pytest.fixture
def provider(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_after_each_batch_rings_equal_the_batch_result(spark, tmp_path, provider):
    """A hot key, a null key and ties of time; resets within a batch, restarts between batches."""
    rng = random.Random(5)
    path, out, rows = f"{tmp_path}/requests", f"{tmp_path}/states", []
    for part in range(4):
        new = []
        for _ in range(70):
            i = len(rows) + len(new)
            key = rng.choice(["hot", "hot", "hot", "b", None])
            reset = part in (1, 3) and rng.random() < 0.05
            new.append((key, T0 + dt.timedelta(seconds=i // 2), i, rng.random() < 0.8, rng.randrange(90), rng.choice([None, 7]), 3, reset or None))
        rng.shuffle(new)
        rows += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        feed = rings.request_rings(spark.readStream.schema(SCHEMA).parquet(path), F.col("gateway"), F.col("reset"), ring=20, history=5, parts=3)
        q = feed.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = {r.key: r for r in rings.merged(spark.read.parquet(out), ring=20, history=5).collect()}
        assert set(got) == {r[0] for r in rows}
        for key, r in got.items():
            own = [x for x in rows if x[0] == key]
            since = max((x[1] for x in own if x[7]), default=T0)
            asked = sorted((x for x in own if not x[7]), key=lambda x: (x[1], x[2]))
            counted = [x for x in asked if x[1] >= since]
            assert (r.total, r.succeeded, r.latency_ms) == (len(counted), sum(x[3] for x in counted), sum(x[4] for x in counted))
            assert (r.tokens_before, r.tokens_after) == (sum(x[5] or 0 for x in counted), 3 * len(counted))
            assert r.history == [x[2] for x in asked[::-1][:5]]
            table = spark.createDataFrame(counted, SCHEMA)
            assert (r.n, r.p50) == tuple(telemetry.upper_median(table, "latency_ms", ring=20, order=("ts", "id")).first())


def test_no_requests_and_resets_only(spark, tmp_path, provider):
    path, out = f"{tmp_path}/requests", f"{tmp_path}/states"
    spark.createDataFrame([("a", T0, None, None, None, None, None, True)], SCHEMA).write.parquet(path)
    feed = rings.request_rings(spark.readStream.schema(SCHEMA).parquet(path), F.col("gateway"), F.col("reset"), parts=2)
    q = feed.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in rings.merged(spark.read.parquet(out)).collect()] == [("a", 0, 0, 0, 0, 0, 0, 0, [])]
