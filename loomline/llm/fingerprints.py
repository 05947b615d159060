"""Document fingerprints: context-triggered piecewise hashing and its comparison.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever it leaves the remainder -1 by the block size,
so chunks follow the content and not its place. Each chunk gives one letter. A fingerprint is the block size, the
signature at it and the one at twice that size; two are compared by edit distance where their block sizes meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, tidy

WINDOW = 7
LEAST = 3  # smallest block size; the others are this times a power of two
LENGTH = 64  # letters of a signature at most
HALVINGS = 8
RUN = 4  # letters in a row that two signatures must share to be alike at all
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PART = 4_000_000  # bytes hashed at once
_powers = np.array([pow(0x01000193, k + 1, 1 << 32) for k in range(WINDOW)], np.uint32)


def _triggers(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends of chunks, their level) for the levels from ``level``: at level k the block size LEAST * 2**k triggers."""
    at, up = [], []
    for lo in range(0, len(data), PART):
        part = data[max(0, lo - WINDOW + 1) : lo + PART].astype(np.uint32) + np.uint32(1)
        skip = lo - max(0, lo - WINDOW + 1)
        h = part * _powers[0]
        for k in range(1, WINDOW):
            h[k:] += part[:-k] * _powers[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h = h[skip:] + np.uint32(1)
        i = np.flatnonzero((h & np.uint32((1 << level) - 1)) == 0)
        g = h[i]
        keep = (g % np.uint32(LEAST) == 0) & (g != 0)
        i, g = i[keep], g[keep]
        at.append(i + lo + 1)
        up.append(np.bitwise_count((g & (~g + np.uint32(1))) - np.uint32(1)))
    return (np.concatenate(at), np.concatenate(up)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


def _signature(data: bytes, ends: np.ndarray) -> str:
    """A letter for each chunk; the last takes all that is left."""
    cuts = [0, *ends[: LENGTH - 1].tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    return "".join([LETTERS[zlib.crc32(view[a:b]) & 63] for a, b in zip(cuts, cuts[1:], strict=False)])


@lru_cache(maxsize=2)  # a text is first the next of its predecessor
def fingerprint(text: str) -> str:
    """``size:signature:signature at twice the size``; of an empty text ``3::``."""
    data = text.encode("utf-8", "surrogatepass")
    level = max(0, (max(len(data) - 1, 0) // (LEAST * LENGTH)).bit_length())
    low = max(0, level - HALVINGS)
    ends, up = _triggers(np.frombuffer(data, np.uint8), low)
    while level > low and np.count_nonzero(up >= level) < LENGTH // 2 - 1:
        level -= 1
    return f"{LEAST << level}:{_signature(data, ends[up >= level])}:{_signature(data, ends[up > level])}"


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one machine-word step per letter."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & places.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 minus the share of letters to insert or delete to turn a into b; 0 without a common run of ``RUN`` letters."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_letters(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1. Equal fingerprints are 1; block sizes must be equal or one the double of the other."""
    if x == y:
        return 1.0
    (n, a, a2), (m, b, b2) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a, b), _alike(a2, b2))
    if n == 2 * m:
        return _alike(a, b2)
    return _alike(a2, b) if m == 2 * n else 0.0


def _range_of(bounds: list, col) -> object:
    """Number of bounds below the value (a null: 0), found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda arr: F.size(F.filter(arr, lambda b: b < col))
    tops = F.array(*[F.lit(g[-1]) for g in groups])
    nested = F.array(*[F.array(*[F.lit(x) for x in g]) for g in [*groups, groups[-1][:0] or groups[-1]]])
    c = below(tops)
    return F.when(col.isNull(), F.lit(0)).when(c >= len(groups), F.lit(len(bounds))).otherwise(c * step + below(F.element_at(nested, c + 1)))


def _head(text) -> object:
    """The first seven bytes of a text as a number: its order is that of the texts."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def _cuts(spark, rows: DataFrame, n: int) -> tuple[list, list, dict]:
    """How (id, text) is cut into about ``n`` ranges: (bounds of ids, number of ranges before each of them, bounds of heads by hot id).

    Quantiles of the ids are the bounds. An id that is several quantiles, or null as often, is hot: its rows are cut again by quantiles of
    their heads. Everything gathered is a list of about ``n`` numbers.
    """
    ids = rows.select("id")
    found = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10000).alias("q"), F.count_if(F.col("id").isNull()).alias("nulls"), F.count("*").alias("rows")).first()
    times = Counter(found["q"] or [])
    bounds = sorted(times)
    want = {k: c for k, c in times.items() if c > 1} | ({None: -(-n * found["nulls"] // found["rows"])} if found["nulls"] * n > found["rows"] else {})
    hot = {}
    if want:
        m = max(want.values())
        named = F.broadcast(spark.createDataFrame([(k,) for k in want], "hot long"))  # at most ``n`` ids
        for r in rows.join(named, F.col("id").eqNullSafe(F.col("hot"))).groupBy("hot").agg(F.percentile_approx(_head(F.col("text")), [i / m for i in range(1, m)] or [0.5], 10000).alias("q")).collect():
            c = want[r["hot"]]
            hot[r["hot"]] = sorted({r["q"][max(1, i * m // c) - 1] for i in range(1, c)})
    before, at = [], len(hot.get(None, ()))
    for b in bounds:
        before.append(at)
        at += 1 + len(hot.get(b, ()))
    return bounds, [*before, at], hot


def _placed(spark, rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (id, text) with x, the head of texts of hot ids (others: 0), and p, the number of their range in the order of id and text."""
    bounds, before, hot = _cuts(spark, rows, n)
    offset = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.element_at(F.array(*[F.lit(b) for b in before]), _range_of(bounds, F.col("id")) + 1))
    if not hot:
        return rows.withColumn("x", F.lit(0).cast("long")).withColumn("p", offset)
    table = F.broadcast(spark.createDataFrame(list(hot.items()), "hot long, cuts array<long>"))  # about ``n`` numbers
    x = F.when(F.col("cuts").isNotNull(), _head(F.col("text"))).otherwise(F.lit(0).cast("long"))
    rows = rows.join(table, F.col("id").eqNullSafe(F.col("hot")), "left").withColumn("x", x)
    within = F.coalesce(F.size(F.filter("cuts", lambda b: b < F.col("x"))), F.lit(0))
    return rows.withColumn("p", offset + F.when(F.col("cuts").isNull(), 0).otherwise(within)).drop("hot", "cuts")


def with_next(docs: DataFrame, fn, schema: str, *, id_col: str, text_col: str) -> DataFrame:
    """Apply ``fn(id, text, next text)`` to every row, next in ascending id (nulls first, ties by text), after the last the first.

    Rows are dealt into ranges of ids, one a task; many rows of one id, or of none, are cut by how their texts begin. The first row of
    each range is also sent to the range before it, so that texts are shuffled once and every task streams its range.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    rows = _placed(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), n)
    firsts = rows.groupBy("p").agg(F.min(F.struct("id", "x")).alias("first")).orderBy("p").select("p", "first.*").collect()  # a row per range; nulls come first
    ahead = [(r["p"], r["id"], r["x"], firsts[i - 1]["p"]) for i, r in enumerate(firsts)]
    if ahead:
        table = F.broadcast(spark.createDataFrame(ahead, "p int, first long, first_x long, before int"))  # a row per range
        own = F.struct(F.col("p").alias("p"), F.lit(False).alias("look"))
        more = F.struct(F.col("before").alias("p"), F.lit(True).alias("look"))
        leads = F.col("id").eqNullSafe(F.col("first")) & (F.col("x") == F.col("first_x"))
        rows = rows.join(table, "p").select("id", "text", F.explode(F.when(leads, F.array(own, more)).otherwise(F.array(own))).alias("to")).select("id", "text", "to.p", "to.look")
    else:
        rows = rows.select("id", "text", "p", F.lit(False).alias("look"))
    rows = rows.repartitionById(max([n, *[r["p"] + 1 for r in firsts]]), F.col("p")).sortWithinPartitions("p", "look", F.col("id").asc_nulls_first(), "text").select("p", "look", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None  # the row that waits for its next text
        for batch in batches:
            out = []
            for p, look, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and p == of:
                    out.append(fn(*held, text))
                held, of = (None if look else (key, text)), p
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(tidy(run), schema)


def _compared(key: int | None, text: str, following: str) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    a, c = fingerprint(text), fingerprint(following)
    b = fingerprint.__wrapped__(edited)
    return {"id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": a, "edited_fingerprint": b, "near_edited": likeness(a, b), "near_next": likeness(a, c)}


def fingerprint_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one, with fingerprint ``3::``; a single document is its own next. Ties of the id are
    ordered by text, nulls come first; repeated rows stay rows. Further columns are ignored; no rows give no rows.
    """
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, _compared, schema, id_col=id_col, text_col=text_col).withColumnRenamed("id", id_col)
