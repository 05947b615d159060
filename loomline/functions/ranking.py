"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written

_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def numbered(df: DataFrame, key: Column, *ties: Column, name: str = "nth", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with its row number (from 1) by a key (nulls first), then by ``ties``.

    Spark's range partitioning samples the key and the ties together, so many rows of one key are cut too; only rows that
    are equal in all of them share a range, in any order. Every range is sorted by itself and written out with its places,
    then the sizes of the ranges before are added: a row per range is all that is gathered. ``ranges`` defaults to the
    session's shuffle partitions. ``df`` is read twice, once for the sample: hand over a written table, and narrow rows.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [key.desc_nulls_first() if descending else key.asc_nulls_first(), *ties]
    placed = written(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    mask = F.lit((1 << _BITS) - 1)
    placed = placed.withColumn("__range", F.shiftright("__at", _BITS)).withColumn("__at", F.col("__at").bitwiseAND(mask))
    sizes = placed.groupBy("__range").agg(F.max("__at").alias("__last"))  # a row per range
    before = sizes.select("__range", (F.sum(F.col("__last") + 1).over(W.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__last")).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def trailing(df: DataFrame, rows: int, values: dict[str, Column], order: Sequence[Column], key: Column | None = None, block: int = 100_000) -> DataFrame:
    """``df`` with aggregates over each row and the ``rows`` - 1 before it in a whole table's order, or in that of its ``key``, without one task per order or key.

    Rows are numbered and cut into blocks of at least ``block``; the last rows of a block are also sent to the next one, where they
    are in the windows only. A task sees its blocks and these rows, however many rows have one key. ``order`` should have no
    ties: equal rows come in any order. Hand over narrow rows.
    """
    block, halo = max(block, rows), rows - 1
    key = F.lit(0) if key is None else key
    placed = numbered(df.withColumn("__key", key), F.col("__key"), *order, name="__nth")
    own, at = F.floor((F.col("__nth") - 1) / block), (F.col("__nth") - 1) % block
    ahead = F.struct((own + 1).alias("block"), F.lit(True).alias("look"))
    here = F.struct(own.alias("block"), F.lit(False).alias("look"))
    sent = placed.withColumn("__to", F.explode(F.when(at >= block - halo, F.array(here, ahead)).otherwise(F.array(here))))
    w = W.partitionBy("__to.block", "__key").orderBy("__nth").rowsBetween(-halo, 0)
    out = sent.select("*", *[value.over(w).alias(name) for name, value in values.items()])
    return out.filter(~F.col("__to.look")).drop("__to", "__nth", "__key")
