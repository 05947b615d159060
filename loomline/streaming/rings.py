"""Request rings as a stream with state: counters, the last latencies and the last requests outlive micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from ..sources.scratch import ship

COUNTED = ("latency_ms", "tokens_before", "tokens_after")  #: summed since the last reset
REQUEST = "ts long, id long, ok boolean, latency_ms long, tokens_before long, tokens_after long"
RESET = -(2**63)


class _Rings(StatefulProcessor):
    """Of one part of a key's requests: sums since the last reset, and the newest requests since it and before it."""

    def __init__(self, ring: int, history: int):
        self.ring, self.history = ring, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", REQUEST)
        self.sums = handle.getValueState("sums", "version long, reset long, total long, succeeded long, latency_ms long, tokens_before long, tokens_after long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, reset, *sums = self.sums.get() if self.sums.exists() else (0, RESET, 0, 0, 0, 0, 0)
        got = pd.concat(list(rows), ignore_index=True)  # numbers of one part of a key in one micro-batch
        resets = got.loc[got["reset"], "ts"]
        if len(resets) and int(resets.max()) >= reset:
            reset, sums = int(resets.max()), [0, 0, 0, 0, 0]
        asked = got[~got["reset"]]
        counted = asked[asked["ts"] >= reset]
        sums = [a + int(b) for a, b in zip(sums, (len(counted), counted["ok"].sum(), *(counted[c].sum() for c in COUNTED)), strict=True)]
        newest = asked.nlargest(max(self.ring, self.history), ["ts", "id"])[["ts", "id", "ok", *COUNTED]]
        held = sorted([*map(tuple, self.kept.get()), *newest.itertuples(index=False, name=None)], reverse=True)[: max(self.ring, self.history)]
        held = [(int(t), int(i), bool(ok), int(a), int(b), int(c)) for t, i, ok, a, b, c in held]
        self.kept.put(held) if held else self.kept.clear()  # an empty list can't be put
        self.sums.update((version + 1, reset, *sums))
        names = [c.split()[0] for c in REQUEST.split(", ")]
        yield pd.DataFrame([(*key, version + 1, reset, *sums, [dict(zip(names, r, strict=True)) for r in held])], columns=["key", "part", "version", "reset", "total", "succeeded", *COUNTED, "kept"])

    def close(self) -> None:
        pass


def request_rings(requests: DataFrame, key: Column, reset: Column, ring: int = 100, history: int = 20, parts: int = 16) -> DataFrame:
    """Stream of the rings' states as they change: (key, part, version, reset, total, succeeded, sums, kept); ``merged`` makes a key's figures of the last ones.

    requests: ts, id, ok, latency_ms, tokens_before, tokens_after. A row where ``reset`` holds is no request: it zeroes its key's counters and ring
    of latencies at its ts, and leaves the history. A key's requests are cut into ``parts`` by id, so a hot key is several states; a reset goes
    to all of them. A state is its sums and at most max(ring, history) requests; null numbers count as 0, null ts or id as the least, a null flag as false.
    Requests of a micro-batch come in any order; those before the last reset don't count. One that comes in a later batch than
    a reset after it doesn't either; one that came in an earlier batch than a reset before it is forgotten by the counters, as it is zeroed then.
    """
    ship(requests.sparkSession)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    is_reset = F.coalesce(reset, F.lit(False))
    part = F.explode(F.when(is_reset, F.array(*[F.lit(i) for i in range(parts)])).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))))
    ts = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(RESET))
    rows = requests.select(key.cast("string").alias("key"), ts.alias("ts"), F.coalesce(F.col("id").cast("long"), F.lit(RESET)).alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"), *[number(c) for c in COUNTED], is_reset.alias("reset"), part.alias("part"))
    out = f"key string, part int, version long, reset long, total long, succeeded long, {', '.join(f'{c} long' for c in COUNTED)}, kept array<struct<{REQUEST.replace(' ', ':').replace(',:', ',')}>>"
    return rows.groupBy("key", "part").transformWithStateInPandas(_Rings(ring, history), out, "update", "none")


def merged(states: DataFrame, ring: int = 100, history: int = 20) -> DataFrame:
    """(key, total, succeeded, sums, n, p50, history) of the states that a stream of ``request_rings`` has given so far: of each part the last one counts.

    p50 is the upper median of the last ``ring`` latencies since the reset (0 of none), history the ids of the last ``history`` requests, newest first. At most
    parts times max(ring, history) requests of a key meet.
    """
    last = states.groupBy("key", "part").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("key", "part")]), "version").alias("s")).select("key", "part", "s.*")
    last = last.withColumn("reset", F.max("reset").over(W.partitionBy("key")))
    newest = F.reverse(F.array_sort(F.flatten(F.collect_list("kept"))))
    one = last.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", "succeeded", *COUNTED)], F.max("reset").alias("reset"), newest.alias("kept"))
    latencies = F.array_sort(F.transform(F.slice(F.filter("kept", lambda r: r["ts"] >= F.col("reset")), 1, ring), lambda r: r["latency_ms"]))
    out = one.withColumn("v", latencies).withColumn("n", F.size("v").cast("long"))
    p50 = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.get("v", F.floor(F.col("n") * 0.5).cast("int")))
    return out.select("key", "total", "succeeded", *COUNTED, "n", p50.alias("p50"), F.transform(F.slice("kept", 1, history), lambda r: r["id"]).alias("history"))
