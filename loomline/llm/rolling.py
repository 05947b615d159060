"""Rolling exact medians over time windows, and the median absolute deviation beside them.

Time is cut into blocks as long as the window. The window of an event is a suffix of the block before its own and a
prefix of its own block. Both blocks are kept as persistent counted trees over their values, one version per event in
time order, as arrays of counts per level: a prefix is a version, a suffix is the last version less one. They lie side by
side in one array, so descending both trees at once takes the difference of two versions at each node. A descent selects a rank; the deviations
around a median are two sorted runs of the same window, met by bisection over descents.

Spark deals the blocks to tasks. A block with too many events is cut into parts in time. A part needs in full only the
events that come or go while it lasts; what stays in its window throughout comes as counts per value, added up by Spark.
So no task holds more than a part's events and the distinct values of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy, written

LARGEST = 1 << 58  # scaled values from here on count as missing: their deviations would leave 64 bits
CELLS = 1024  # parts of a block at most, a power of two; what is left in one is bounded by its distinct microseconds and cents
AT_ONCE = 32_768  # rows of whole groups that are worked on together


class CountedTree:
    """Versions of a counted tree over small ints: per level, how many (and of what weight) of the first i elements go left."""

    def __init__(self, ranks: np.ndarray, weights: np.ndarray | None):
        self.depth = max(1, int(ranks.max()).bit_length()) if len(ranks) else 1
        self.left, self.weight = [], []
        for level in range(self.depth - 1, -1, -1):
            goes = (ranks >> level) & 1 == 0
            self.left.append(np.concatenate([[0], np.cumsum(goes)]))
            order = np.concatenate([np.flatnonzero(goes), np.flatnonzero(~goes)])
            if weights is not None:
                self.weight.append(np.concatenate([[0], np.cumsum(np.where(goes, weights, 0))]))
                weights = weights[order]
            ranks = ranks[order]

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least (from 0, by weight) among the elements that version ``hi`` has and version ``lo`` hasn't."""
        found = np.zeros(len(k), np.int64)
        for level, left in enumerate(self.left):
            a, b = left[lo], left[hi]
            n = self.weight[level][hi] - self.weight[level][lo] if self.weight else b - a
            right = k >= n
            k = k - np.where(right, n, 0)
            lo, hi = np.where(right, left[-1] + lo - a, a), np.where(right, left[-1] + hi - b, b)
            found = found * 2 + right
        return found


def window_medians(group: np.ndarray, at: np.ndarray, values: np.ndarray, weights: np.ndarray | None, asked: np.ndarray, asked_at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, median2, mad4) of the values of one's group at ``asked_at - length`` to ``asked_at``, for each (group, time) asked. Elements are sorted by group and time; times are 0 to 2 * length."""
    shift = np.int64((2 * length).bit_length() + 1)
    key = (group << shift) + at
    lo = np.searchsorted(key, (asked << shift) + np.maximum(0, asked_at - length), "left")
    hi = np.searchsorted(key, (asked << shift) + asked_at, "right")
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    distinct = np.cumsum(new_group | np.concatenate([[True], v[1:] != v[:-1]])) - 1 if len(g) else np.zeros(0, np.int64)
    table = np.zeros(int(distinct[-1]) + 1 if len(g) else 1, np.int64)
    table[distinct] = v
    base = np.zeros(int(max(group.max(initial=0), asked.max(initial=0))) + 1, np.int64)
    base[g[new_group]] = distinct[new_group]
    ranks = np.empty(len(g), np.int64)
    ranks[order] = distinct - base[g]
    tree = CountedTree(ranks, weights)
    total = np.concatenate([[0], np.cumsum(weights)]) if weights is not None else np.arange(len(g) + 1)
    n = total[hi] - total[lo]
    median2, mad4 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    some = np.flatnonzero(n >= 2)
    if not len(some):
        return n, median2, mad4
    lo, hi, m, own = lo[some], hi[some], n[some], base[asked[some]]

    def nth(k: np.ndarray, who: np.ndarray | None = None) -> np.ndarray:
        return table[own + tree.select(lo, hi, k)] if who is None else table[own[who] + tree.select(lo[who], hi[who], k)]

    mid = (m - 1) // 2
    median = nth(mid) + nth(m // 2)
    # the mid + 1 values nearest to the median are a run of the sorted window: bisect where it begins
    first, last = np.zeros(len(m), np.int64), np.minimum(mid + 1, m - mid - 1)
    while True:
        open_ = np.flatnonzero(first < last)
        if not len(open_):
            break
        x = (first[open_] + last[open_]) // 2
        both = nth(np.concatenate([x, x + mid[open_] + 1]), np.concatenate([open_, open_]))
        q = median[open_]
        nearer = q - 2 * both[: len(x)] > 2 * both[len(x) :] - q  # the run begins further on
        first[open_] = np.where(nearer, x + 1, first[open_])
        last[open_] = np.where(nearer, last[open_], x)
    dev = np.maximum(median - 2 * nth(first), 2 * nth(first + mid) - median)
    even = np.flatnonzero(m % 2 == 0)
    below = np.full(len(m), np.iinfo(np.int64).max)
    i = even[first[even] > 0]
    below[i] = median[i] - 2 * nth(first[i] - 1, i)
    i = even[first[even] + mid[even] + 1 < m[even]]
    below[i] = np.minimum(below[i], 2 * nth(first[i] + mid[i] + 1, i) - median[i])
    second = dev.copy()
    second[even] = below[even]
    median2[some], mad4[some] = median, dev + second
    return n, median2, mad4


def _medians(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def solved(t: pa.Table) -> pa.RecordBatch:
            new = _starts(t)
            group = np.cumsum(new) - 1
            asks = t["asks"].to_numpy()
            has = pc.is_valid(t["cents"]).to_numpy(zero_copy_only=False)
            at = t["at"].to_numpy()
            cents = pc.fill_null(t["cents"], 0).to_numpy()
            weights = t["weight"].to_numpy()[has]
            n, median2, mad4 = window_medians(group[has], at[has], cents[has], None if (weights == 1).all() else weights, group[asks], at[asks], length)
            out = t.filter(pa.array(asks)).combine_chunks()
            none = n < 2
            us = out["at"].to_numpy() + (out["block"].to_numpy() - 1) * length
            columns = [out["event"], out["series"], pa.array(us), out["cents"], pa.array(n), pa.array(median2, mask=none), pa.array(mad4, mask=none)]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["event", "series", "us", "cents", "n", "median2", "mad4"])

        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                t = pa.Table.from_batches(kept).combine_chunks()
                cut = int(np.flatnonzero(_starts(t))[-1])  # the last group may go on
                if cut:
                    yield solved(t.slice(0, cut))
                    t = t.slice(cut)
                kept, rows = pa.Table.from_batches(t.to_batches()).to_batches(), (t.num_rows if cut else 0)
        if kept:
            yield solved(pa.Table.from_batches(kept).combine_chunks())

    return run


def _starts(t: pa.Table) -> np.ndarray:
    """Where a new group of (series, block, part) begins."""
    codes = pc.fill_null(pc.dictionary_encode(t["series"].combine_chunks()).indices, -1).to_numpy()
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for x in (codes, t["block"].to_numpy(), t["part"].to_numpy()):
        new[1:] |= x[1:] != x[:-1]
    return new


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp's own clock, whatever zone the session has."""
    return F.expr(f"unix_date(to_date(`{ts}`)) * 86400000000L + hour(`{ts}`) * 3600000000L + minute(`{ts}`) * 60000000L + cast(extract(SECOND FROM `{ts}`) * 1000000 AS long)")


def rolling_medians(events: DataFrame, minutes: int = 60, *, id_col: str = "click_id", ts_col: str = "ts", series_col: str = "kind", value_col: str = "value", scale: int = 100, most: int = 500_000) -> DataFrame:
    """One row per event: id, series, cents, n, median2, mad4, far.

    Each id counts once (of rows that differ the least by time, series and value; a null id is one id), events without a time are dropped; a null
    series is a series. cents is the value times ``scale``, rounded half up; null values, those that aren't finite and those
    of 2**58 cents and more have none. The window holds the cents of the series from ``minutes`` before to the event, all events
    of its own microsecond included. n counts them; median2 is the sum of the two middle ones (twice the only one), mad4 the
    same of ``|2 * cents - median2|``; far says that an event lies more than three (halved) deviations off. With n below 2
    all three are null, far is null too without own cents. Further columns, whatever their names, are ignored; no rows give none.

    Two blocks of a series with over ``most`` events together are cut into parts (a number of parts per block, not of rows: equal times stay
    together, as counts per value). Block counts stay in the shared folder; nothing is collected, and Spark broadcasts by size only.
    """
    spark, length = events.sparkSession, minutes * 60_000_000
    ship(spark)
    x = F.col(f"`{value_col}`").cast("double") * scale + 0.5
    cents = F.when(F.abs(x) < float(LARGEST), F.floor(x)).cast("long")
    rows = events.filter(F.col(f"`{ts_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("event"), micros(ts_col).alias("us"), F.col(f"`{series_col}`").alias("series"), cents.alias("cents"))
    one = rows.groupBy("event").agg(F.min(F.struct("us", "series", "cents")).alias("e")).select("event", "e.*")
    one = written(one.withColumn("off", F.pmod("us", F.lit(length))).select("event", "series", "us", "cents", "off", F.expr(f"(us - off) div {length}L").alias("block")), "rolling")

    sizes = one.groupBy("series", "block").agg(F.count("cents").alias("n"))
    pairs = sizes.unionByName(sizes.withColumn("block", F.col("block") + 1)).groupBy("series", "block").agg(F.sum("n").alias("n"))
    hot = written(pairs.filter(F.col("n") > most).select("series", "block"), "rolling-hot")  # a row per block cut
    split = not hot.isEmpty()
    if split:
        hot = written(_cut(one, hot, most, length), "rolling-cuts")  # what a block's own events and those of the next block are cut into
        own = hot.select("series", "block", "parts", F.lit(None).cast("long").alias("next_parts"))
        after = hot.select("series", (F.col("block") - 1).alias("block"), F.lit(None).cast("long").alias("parts"), F.col("parts").alias("next_parts"))
        cuts = own.unionByName(after).groupBy("series", "block").agg(F.max("parts").alias("parts"), F.max("next_parts").alias("next_parts")).withColumnRenamed("series", "s").withColumnRenamed("block", "b")
        one = one.join(cuts, F.col("series").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    else:
        one = one.withColumn("parts", F.lit(None).cast("long")).withColumn("next_parts", F.lit(None).cast("long"))

    none = F.lit(None).cast(rows.schema["event"].dataType)
    ask = F.when(F.col("parts").isNull(), F.struct("block", (F.col("off") + length).alias("at"), F.col("event").alias("event"), F.lit(True).alias("asks")))
    give = F.when(F.col("next_parts").isNull() & F.col("cents").isNotNull(), F.struct((F.col("block") + 1).alias("block"), F.col("off").alias("at"), none.alias("event"), F.lit(False).alias("asks")))
    met = one.select("series", "cents", F.explode(F.filter(F.array(ask, give), lambda e: e.isNotNull())).alias("e")).select("series", "e.block", F.lit(0).cast("long").alias("part"), "e.at", "cents", F.lit(1).cast("long").alias("weight"), "e.event", "e.asks")
    if split:
        met = met.unionByName(_parts(one.filter("parts IS NOT NULL OR next_parts IS NOT NULL"), length, none))
    kind, name = rows.schema["event"].dataType.simpleString(), rows.schema["series"].dataType.simpleString()
    dealt = met.repartition("series", "block", "part").sortWithinPartitions("series", "block", "part", "at")
    out = dealt.mapInArrow(tidy(_medians(length)), f"event {kind}, series {name}, us long, cents long, n long, median2 long, mad4 long")
    if split:  # events of cut blocks find the row of their microsecond
        out = written(out, "rolling-out")
        times = out.join(hot.select(F.col("series").alias("s"), F.col("block").alias("b")), F.col("series").eqNullSafe(F.col("s")) & (F.expr(f"(us - pmod(us, {length}L)) div {length}L") == F.col("b")), "left_semi")
        times = times.select(F.col("series").alias("s"), F.col("us").alias("u"), "n", "median2", "mad4")
        cold = out.join(hot.select(F.col("series").alias("s"), F.col("block").alias("b")), F.col("series").eqNullSafe(F.col("s")) & (F.expr(f"(us - pmod(us, {length}L)) div {length}L") == F.col("b")), "left_anti")
        found = one.filter("parts IS NOT NULL").join(times, F.col("series").eqNullSafe(F.col("s")) & (F.col("us") == F.col("u")))
        out = cold.unionByName(found.select(*cold.columns))
    far = F.when(F.col("n") >= 2, 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 3 * F.col("mad4"))
    return out.select(F.col("event").alias(id_col), F.col("series").alias(series_col), "cents", "n", "median2", "mad4", far.alias("far"))


def _cut(one: DataFrame, hot: DataFrame, most: int, length: int) -> DataFrame:
    """(series, block, parts) of the blocks to cut: the least power of two, up to ``CELLS``, with no part above ``most``."""
    met = one.filter("cents IS NOT NULL").groupBy("series", "block", F.expr(f"(off * {CELLS}) div {length}L").alias("cell")).agg(F.count("*").alias("n"))
    met = met.unionByName(met.withColumn("block", F.col("block") + 1)).withColumnRenamed("series", "s").withColumnRenamed("block", "b")
    own = hot.join(met, F.col("series").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    tried = F.explode(F.array(*[F.lit(1 << i).cast("long") for i in range(1, CELLS.bit_length())]))
    sizes = own.select("series", "block", "cell", "n", tried.alias("parts")).groupBy("series", "block", "parts", F.expr(f"(cell * parts) div {CELLS}").alias("part")).agg(F.sum("n").alias("n"))
    worst = sizes.groupBy("series", "block", "parts").agg(F.max("n").alias("n"))
    return worst.groupBy("series", "block").agg(F.coalesce(F.min(F.when(F.col("n") <= most, F.col("parts"))), F.lit(CELLS).cast("long")).alias("parts"))


def _parts(one: DataFrame, length: int, none: Column) -> DataFrame:
    """Rows of cut blocks, equal ones as one with a weight: what comes or goes while a part lasts in full, what its windows hold throughout per value."""
    flat = one.groupBy("series", "block", "off", "cents", "parts", "next_parts").agg(F.count("*").alias("weight"))
    chunk = lambda parts: F.expr(f"(off * {parts}) div {length}L")
    row = lambda block, part, at, asks: [F.col("series"), block.alias("block"), part.alias("part"), at.alias("at"), F.col("cents"), F.col("weight"), none.alias("event"), F.lit(asks).alias("asks")]
    own, after = flat.filter("parts IS NOT NULL"), flat.filter("next_parts IS NOT NULL AND cents IS NOT NULL")
    comes = own.filter("cents IS NOT NULL").select(*row(F.col("block"), chunk("parts"), F.col("off") + length, False))
    goes = after.select(*row(F.col("block") + 1, chunk("next_parts"), F.col("off"), False))
    asked = own.groupBy("series", "block", "off", "parts").agg(F.lit(0).cast("long").alias("weight")).withColumn("cents", F.lit(None).cast("long")).select(*row(F.col("block"), chunk("parts"), F.col("off") + length, True))
    stay = lambda df, parts: df.filter("cents IS NOT NULL").groupBy("series", "block", parts, chunk(parts).alias("chunk"), "cents").agg(F.sum("weight").alias("weight"))
    until = stay(own, "parts").filter("chunk < parts - 1").withColumn("part", F.explode(F.expr("sequence(chunk + 1, parts - 1)"))).select(*row(F.col("block"), F.col("part"), F.lit(length).cast("long"), False))
    since = stay(after, "next_parts").filter("chunk > 0").withColumn("part", F.explode(F.expr("sequence(0L, chunk - 1)"))).select(*row(F.col("block") + 1, F.col("part"), F.lit(length - 1).cast("long"), False))
    held = until.unionByName(since).groupBy("series", "block", "part", "at", "cents").agg(F.sum("weight").alias("weight")).select(*row(F.col("block"), F.col("part"), F.col("at"), False))
    return comes.unionByName(goes).unionByName(asked).unionByName(held)


#: The same in DuckDB's SQL, over the view ``clicks``.
ORACLE_SQL = """
WITH one AS (
  SELECT DISTINCT ON (click_id) click_id, ts, kind, floor(100 * value + 0.5)::BIGINT AS c FROM clicks WHERE ts IS NOT NULL ORDER BY click_id, ts, kind NULLS FIRST, value NULLS FIRST),
w AS (
  SELECT click_id, kind, c, list_sort(list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)) AS v FROM one),
m AS (SELECT click_id, kind, c, coalesce(len(v), 0)::BIGINT AS n, v, CASE WHEN len(v) >= 2 THEN v[(len(v) + 1) // 2] + v[len(v) // 2 + 1] END AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(v, lambda x: abs(2 * x - median2))) AS dev FROM m),
r AS (SELECT click_id, kind, c, n, median2, CASE WHEN n >= 2 THEN dev[(n + 1) // 2] + dev[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, c AS cents, n, median2, mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM r
"""
