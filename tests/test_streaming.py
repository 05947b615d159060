import datetime as dt

from loomline.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, name):
    path = f"{tmp_path}/{name}"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_debounce(spark, tmp_path):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    rows = [[(at(0), "a.ts"), (at(100), "b.ts"), (at(150), "a.ts"), (at(900), "c.ts"), (at(950), "x/dist/d.ts"), (at(960), "e.md")], [(at(60_000), "z.ts")], [(at(120_000), "y.ts")]]
    feed = changes.watched(stream(spark, tmp_path, rows, "ts timestamp_ntz, path string", "feed"))
    drained(changes.debounced(feed), "append", "bursts")
    bursts = spark.table("bursts")
    assert {tuple(sorted(r.paths)) for r in bursts.collect()} >= {("a.ts", "b.ts"), ("c.ts",)}
    assert {r.path for r in changes.as_jobs(bursts).collect()} >= {"a.ts", "b.ts", "c.ts"}


def test_running_counters_and_windows(spark, tmp_path):
    rows = [[(T0, True, 10, 9, 5), (T0, False, 20, 1, 5)], [(T0 + dt.timedelta(minutes=30), True, 30, 5, 5)]]
    feed = stream(spark, tmp_path, rows, "ts timestamp_ntz, ok boolean, latency_ms long, tokens_raw long, tokens_after long", "requests")
    drained(changes.running_stats(feed), "complete", "counters")
    assert tuple(spark.table("counters").first()) == (3, 2, 60, 4)
    drained(changes.per_window(feed), "append", "windows")
    assert [(r.n, r.latency_ms) for r in spark.table("windows").collect()] == [(2, 15.0)]


def test_upserts_by_batch(spark, tmp_path):
    rows = [[("a", "LOW", 1, 1), ("b", "HIGH", 2, 2)], [("a", "HIGH", 3, 3), ("a", "LOW", 4, 4)]]
    feed = stream(spark, tmp_path, rows, "path string, priority string, seq long, queued_at long", "jobs")
    handle, root = changes.versioned(f"{tmp_path}/out", "path"), f"{tmp_path}/out"
    q = changes.upserting(feed, handle, f"{tmp_path}/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    last = changes.current(spark, root)
    assert {(r.path, r.seq) for r in last.collect()} == {("a", 3), ("b", 2)}
    handle(spark.createDataFrame([("a", "HIGH", 3, 3)], last.schema), 1)  # the batch comes again
    assert changes.current(spark, root).count() == 2


def test_gaps_and_new_checkpoints_lose_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    handle, rows = changes.versioned(root, "path", ("seq",)), lambda *xs: spark.createDataFrame(xs, "path string, seq long")
    handle(rows(("a", 1)), 0, "one")
    handle(rows(("d", 5)), 0, "two")  # another checkpoint starts to count again, at the number of the last version
    handle(rows(("b", 2), ("b", 3)), 2, "one")  # batch 1 never came; a key comes twice
    handle(rows(("d", 9)), 0, "two")  # comes again, after another query's batch: passed over
    handle(rows(("c", 4)), 2)  # no stream: applied
    handle(rows(("c", 6)), 2)
    assert {(r.path, r.seq) for r in changes.current(spark, root).collect()} == {("a", 1), ("b", 3), ("c", 6), ("d", 5)}
    assert changes.current(spark, f"{tmp_path}/none") is None


def test_two_checkpoints_into_one_table(spark, tmp_path):
    """Two queries, each on its first batch: both keep their rows, null keys are replaced as others are."""
    root, schema = f"{tmp_path}/out", "path string, priority string, seq long, queued_at long"
    for name, own in (("one", [("a", "LOW", 1, 1), (None, "LOW", 2, 2)]), ("two", [("b", "LOW", 3, 3), (None, "LOW", 4, 4)])):
        q = changes.upserting(stream(spark, tmp_path, [own], schema, name), changes.versioned(root, "path"), f"{tmp_path}/checkpoint-{name}").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.path, r.seq) for r in changes.current(spark, root).collect()} == {("a", 1), ("b", 3), (None, 4)}
    assert len({q for _, q, _, _ in changes.versions(spark, root)} - {""}) == 2


def test_logs_are_followed(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\n\ntwo\n")
    q = changes.followed(spark, f"{tmp_path}/logs").writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    (tmp_path / "logs" / "b.log").write_text("three\n")
    q.processAllAvailable()
    q.stop()
    assert [r.line for r in spark.table("followed").collect()] == ["one", "two", "three"]
