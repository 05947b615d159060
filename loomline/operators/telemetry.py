"""Request and log telemetry: counters, rings, medians, token flow and stream metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import trailing
from ..functions.rules import log_category
from ..functions.text import round_half_up


def request_stats(requests: DataFrame) -> DataFrame:
    """One row of totals over ok, latency_ms, tokens_raw, tokens_before, tokens_after, tools_before, tools_after."""
    over = lambda a, b: F.coalesce(F.sum(F.greatest(F.lit(0), F.col(a) - F.col(b))), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return requests.agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        total("latency_ms").alias("latency_ms"),
        total("tokens_before").alias("tokens_before"),
        total("tokens_after").alias("tokens_after"),
        over("tokens_raw", "tokens_after").alias("tokens_removed"),
        over("tokens_after", "tokens_before").alias("tokens_injected"),
        over("tools_before", "tools_after").alias("tools_removed"),
    )


def derived_stats(stats: DataFrame, uptime_s: int) -> DataFrame:
    """Average latency, share of tokens saved (negative if there are more) and requests a minute."""
    n = F.col("total")
    return stats.select(
        "*",
        F.when(n > 0, round_half_up(F.col("latency_ms") / n)).otherwise(0).cast("long").alias("avg_latency_ms"),
        F.when(F.col("tokens_before") > 0, round_half_up((1 - F.col("tokens_after") / F.col("tokens_before")) * 100)).otherwise(0).cast("long").alias("saved_pct"),
        (round_half_up(n / F.lit(uptime_s) * 60) if uptime_s > 0 else F.lit(0).cast("long")).alias("per_minute"),
    )


def last_request_age(requests: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """One row: whole seconds since the last request (last_s), -1 if there was none."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(F.col(ts).cast("timestamp")))) / 1_000_000)
    return requests.agg(F.coalesce(age, F.lit(-1)).cast("long").alias("last_s"))


def daemon_status(manifest: DataFrame, pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files of the manifest, jobs that wait and nodes of the graph."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(manifest, "files").join(n(pending, "pending")).join(n(nodes, "nodes"))  # three single rows


def since(requests: DataFrame, reset_ts: Column | None) -> DataFrame:
    """Rows that counters see after a reset; the history doesn't forget."""
    return requests if reset_ts is None else requests.filter(F.col("ts") >= reset_ts)


def latest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest rows: a bounded heap per task, not a sort of the table."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def upper_median(df: DataFrame, value: str, ring: int = 100, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(n, p50) of the last ``ring`` values: the element at half their number from 0, so of an even number the upper one; 0 of none."""
    kept = latest(df, ring, *order).agg(F.sort_array(F.collect_list(value)).alias("v"))  # at most ``ring`` values
    n = F.size("v")
    return kept.select(n.cast("long").alias("n"), F.when(n == 0, F.lit(0)).otherwise(F.element_at("v", (F.floor(n * 0.5) + 1).cast("int"))).alias("p50"))


def token_flow(requests: DataFrame) -> DataFrame:
    """Derived columns of a history row; missing raw and after counts fall back to the count before."""
    raw = F.coalesce("tokens_raw", "tokens_before", F.lit(0))
    before = F.coalesce("tokens_before", F.lit(0))
    after = F.coalesce("tokens_after", "tokens_before", F.lit(0))
    zero = F.lit(0)
    injected = F.greatest(zero, after - before)
    return requests.select(
        "id",
        F.greatest(zero, raw - before).cast("long").alias("ide_removed"),
        injected.cast("long").alias("injected"),
        F.greatest(zero, before + injected - after).cast("long").alias("budget_cut"),
        F.when(raw > 0, round_half_up((raw - after) / raw * 100)).otherwise(0).cast("long").alias("saved_pct"),
    )


def log_counts(lines: DataFrame, faithful: bool = False) -> DataFrame:
    """(category, n) of log lines and their total as ``all``; the faithful total counts uncategorised lines twice."""
    by = lines.groupBy(log_category("line").alias("category")).agg(F.count("*").alias("n"))
    double = F.sum("n") + F.coalesce(F.sum(F.when(F.col("category") == "all", F.col("n"))), F.lit(0))
    total = by.agg((double if faithful else F.sum("n")).cast("long").alias("n")).select(F.lit("all").alias("category"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return by.filter("category != 'all'").unionByName(total)


def log_ring(texts: DataFrame, ring: int = 200) -> DataFrame:
    """Trimmed non-empty lines of (seq, text), the last ``ring`` of them."""
    lines = texts.select("seq", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line != ''")
    return latest(lines, ring, "seq", "pos")


DELTA = "struct<choices:array<struct<delta:struct<content:string,reasoning_content:string>>>>"


def stream_metrics(lines: DataFrame) -> DataFrame:
    """Per request of (request_id, start_ms, t_ms, line): tokens, ttft_ms, tps.

    A token is a data line whose delta has content that isn't empty; reasoning counts only where there is no content.
    Malformed lines and the end mark are skipped. Rates need more than a tenth of a second.
    """
    trimmed = F.trim("line")
    body = F.when(trimmed.startswith("data:"), F.trim(F.substring(trimmed, 6, 1 << 30)))
    delta = F.from_json(F.when(body != "[DONE]", body), DELTA)["choices"][0]["delta"]
    token = F.length(F.coalesce(delta["content"], delta["reasoning_content"], F.lit(""))) > 0
    per = lines.groupBy("request_id").agg(F.count_if(token).alias("tokens"), F.min("start_ms").alias("s"), F.min("t_ms").alias("first"), F.max("t_ms").alias("last"))
    seconds = (F.col("last") - F.col("first")) / 1000
    return per.select("request_id", "tokens", (F.col("first") - F.col("s")).cast("long").alias("ttft_ms"), F.when(seconds > 0.1, round_half_up(F.col("tokens") / seconds)).otherwise(0).cast("long").alias("tps"))


def calibrated_threshold(telemetry: DataFrame, default: float = 0.55) -> DataFrame:
    """One row: the mean score of failed requests that didn't think, less a tenth and a tenth at least; the default without any."""
    mean = F.avg(F.when((F.col("reasoning") == "no_think") & (F.col("success") == 0), F.col("score")))
    return telemetry.agg(mean.alias("m")).select(F.when(F.col("m") > 0, F.greatest(F.lit(0.1), F.col("m") - 0.1)).otherwise(F.lit(default)).alias("threshold"))


def sessions(events: DataFrame, gap: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): events of a key whose gaps are below ``gap``, as the debounce of a change feed groups them."""
    s = F.session_window(F.col(ts), gap)
    return events.groupBy(key, s).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("session_window")


def running(requests: DataFrame, order: tuple[str, ...] = ("ts", "id"), ring: int = 100, key: str | None = None) -> DataFrame:
    """Each request with the mean latency of the last ``ring`` of its key, or of all requests.

    Requests are cut into ranges of their order, each with the ``ring`` - 1 requests before it: neither a whole table nor a key is one task.
    """
    return trailing(requests, ring, {"ring_latency": F.avg("latency_ms")}, [F.col(c) for c in order], None if key is None else F.col(key))
