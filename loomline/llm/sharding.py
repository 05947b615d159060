"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**ring_bits`` cells. A document's key hashes to one cell; the first virtual node at or after a cell
owns it. Cell loads are aggregated (at most ``2**ring_bits`` rows, whatever the table's size) and the ring is walked on
the driver: a cell whose shard is full continues clockwise to the next shard with room. No shard exceeds
``(1 + slack)`` times the mean load, unless one cell alone is larger than what is left anywhere; then it goes to the
least loaded shard.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

LOADS = ("bytes", "rows")
RUN = 100_000  # repeated rows of a piece at most
PIECES = 4096  # pieces of a shard's load from which repeated rows are cut


def ring_nodes(n_shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. A shard's positions don't depend on the number of shards."""
    out = []
    for s in range(n_shards):
        for v in range(vnodes):
            h = hashlib.sha256(f"{s}/{v}".encode()).digest()
            out.append((int.from_bytes(h[:8], "big") % cells, h, s))
    return [(p, s) for p, _, s in sorted(out)]


def place_cells(loads: dict[int, int], n_shards: int, vnodes: int, cells: int, slack: float) -> dict[int, int]:
    """Shard of each cell. Heavy cells choose first, so that what overflows is light and travels little load."""
    nodes = ring_nodes(n_shards, vnodes, cells)
    at = [p for p, _ in nodes]
    clockwise: list[tuple[int, ...]] = [()] * len(nodes)  # the distinct shards in ring order from each node
    seq = list(dict.fromkeys(s for _, s in nodes))
    for i in range(len(nodes) - 1, -1, -1):
        s = nodes[i][1]
        seq = [s, *(x for x in seq if x != s)]
        clockwise[i] = tuple(seq)
    for i in range(len(nodes) - 1, -1, -1):  # once more: the first pass started from an order that wasn't the ring's
        s = nodes[i][1]
        seq = [s, *(x for x in seq if x != s)]
        clockwise[i] = tuple(seq)
    full = [0] * n_shards
    cap = (1 + slack) * sum(loads.values()) / n_shards
    out = {}
    for c in sorted(loads, key=lambda c: (-loads[c], c)):
        order = clockwise[bisect.bisect_left(at, c) % len(nodes)]
        s = next((s for s in order if full[s] + loads[c] <= cap), None)
        if s is None:
            s = min(order, key=lambda s: full[s])
        full[s] += loads[c]
        out[c] = s
    return out


def ring_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", load: str = "bytes", vnodes: int = 256, ring_bits: int = 16, slack: float = 0.002) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1, so a null or empty text weighs 1; the crc of a null text is that of an empty one. The
    ring's key is id and crc, so many rows with a null or repeated id still spread; rows that repeat id and text get a piece
    number too once they pass 1/``PIECES`` of a shard, so loads stay bounded unless one row alone outweighs a shard's room.
    slot numbers a shard's rows from 0, by cell, then id (nulls first), crc, size and piece. ``load`` bounds bytes or rows.
    grown_shard is null: under bounded loads what others weigh decides too. An empty table gives no rows; further
    columns of ``docs``, whatever their names, are ignored. law is null if rows are bounded: cells are placed whole, so counts are near equal only.
    """
    if load not in LOADS:
        raise ValueError(f"load must be one of {LOADS}")
    spark, cells = docs.sparkSession, 1 << ring_bits
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    # repeated rows are counted, and spelled out at the end: a row that a third of the table repeats is one row until then
    same = written(rows.groupBy("id", "crc", "size").agg(F.count("*").alias("times")), "ring")
    weight = F.col("size") if load == "bytes" else F.lit(1).cast("long")
    total = same.agg(F.sum(weight * F.col("times"))).first()[0] or 0
    # what repeats past a small share of a shard is cut into pieces, each with a place of its own on the ring
    each = F.least(F.lit(RUN).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(max(1, total // (n_shards * PIECES))) / weight)))
    pieces = same.withColumn("each", each).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / F.col("each")))))
    pieces = pieces.select("id", "crc", "size", "piece", F.least("each", F.col("times") - F.col("piece") * F.col("each")).alias("n"))
    key = F.when(F.col("piece") == 0, F.xxhash64("id", "crc")).otherwise(F.xxhash64("id", "crc", "size", "piece"))
    pieces = pieces.withColumn("cell", F.pmod(key, F.lit(cells)).cast("int"))
    per_cell = pieces.groupBy("cell").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).collect()  # at most 2**ring_bits rows
    count = {r["cell"]: r["rows"] for r in per_cell}
    placed = place_cells({r["cell"]: r[load] for r in per_cell}, n_shards, vnodes, cells, slack)
    filled, ring = [0] * n_shards, []
    for c in sorted(placed):
        ring.append((c, placed[c], filled[placed[c]]))
        filled[placed[c]] += count[c]
    ring_df = spark.createDataFrame(ring, "cell int, shard int, base long")
    order = W.partitionBy("cell").orderBy(F.col("id").asc_nulls_first(), "crc", "size", "piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.sum("n").over(order)
    return (
        pieces.withColumn("last", last)
        .select("cell", "id", "crc", "size", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("nth"))
        .join(F.broadcast(ring_df), "cell")  # at most 2**ring_bits rows of 16 bytes
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(load if load == "bytes" else None).cast("string").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
