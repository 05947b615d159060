"""Exact nearest vectors for any number of queries: a table of distances to pivots prunes, blocks of what is left are compared by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import ship, written

SLACK = 1e-9  # relative error that bounds and products are allowed


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _usable(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """(name, v) of rows whose id and vector are there, with components that are there and finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias(name), v.alias("v")).filter(F.col(name).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, v) as a table (id, v, row, cell, far): a number of its own, the nearest pivot and the distance to it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                m = _matrix(part["v"])
                cell = _squares(m, pivots).argmin(1)
                yield part.assign(cell=cell.astype(np.int32), far=np.sqrt(((m - pivots[cell]) ** 2).sum(1)))

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return written(rows.mapInPandas(run, f"{own}, cell int, far double").withColumn("row", F.monotonically_increasing_id()), "assigned")


def _asked(queries: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, k: int, shift: float) -> DataFrame:
    """(query, v, cell) for every cell that may hold one of a query's k nearest.

    cells: cell, near (its k least distances to the pivot, ascending) and far (the greatest). By the triangle inequality a query at distance
    d of a pivot has the cell's rows within d + near, so the k-th least of all these bounds its k-th distance; a cell is left out
    where |d - a row's distance| or the distance to the plane between two pivots is beyond that.
    """
    at = cells["cell"].to_numpy()
    p = pivots[at]
    far, least = cells["far"].to_numpy(), np.array([x[0] for x in cells["near"]])
    near = np.full((len(at), k), np.inf)
    for i, x in enumerate(cells["near"]):
        near[i, : len(x)] = x
    between = np.sqrt(_squares(p, p))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 256):
                some = part.iloc[lo : lo + 256]
                m = _matrix(some["v"])
                d = np.sqrt(_squares(m, p))
                reach = (d[:, :, None] + near[None]).reshape(len(m), -1)
                most = np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(m), np.inf)
                own = d.argmin(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - d[np.arange(len(m)), own][:, None] ** 2) / (2 * between[own])
                plane[~np.isfinite(plane)] = 0
                low = np.maximum.reduce([d - far[None], least[None] - d, plane])
                loose = SLACK * (1 + np.abs(d).max(1)) * 10
                q, c = np.nonzero(low <= (np.sqrt(most**2 + shift) + loose)[:, None])
                yield pd.DataFrame({"query": some["query"].to_numpy()[q], "v": some["v"].to_numpy()[q], "cell": at[c].astype(np.int32)})

    kind = queries.schema["query"].dataType.simpleString()
    return queries.mapInPandas(run, f"query {kind}, v array<double>, cell int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "vec_id", query_vector: str = "embedding", digits: int | None = 6, pivots: int = 128, block: int = 16_384, asked: int = 4096) -> DataFrame:
    """(query_id, rank, id, distance): the k vectors nearest to each query by squared Euclidean distance in double precision, ties by id. Exact.

    ``pivots`` different vectors with the least hashes of their ids are the pivots: they, and k distances for each, are all that reaches the driver. Every
    vector belongs to the cell of its nearest pivot; a query goes to the cells that the pivot distances can't rule out. A cell's rows
    are cut into blocks of about ``block`` and its queries into blocks of about ``asked``; a task compares one with the other and keeps k
    rows per query. So a cell that holds most of the table, or one vector repeated all over, is spread too. Where vectors have no
    structure nothing is ruled out, and the cost is that of all products.

    Rows without an id or a vector, or with a null or non-finite component, take no part; neither does a query of zeros only. Vectors must be of
    one length (else an error). Repeated rows are found as often as they stand there; a query that repeats an id is one query with the
    first of its vectors. Other columns are ignored. No rows or no queries give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    shift = 0.0 if digits is None else 2 * 10.0**-digits
    v = _usable(vectors, id_col, vector_col, "id")
    q = _usable(queries, query_id, query_vector, "query").filter(F.exists("v", lambda x: x != 0))
    q = q.groupBy("query").agg(F.min("v").alias("v"))
    kind = {"id": v.schema["id"].dataType.simpleString(), "query": q.schema["query"].dataType.simpleString()}
    schema = f"query {kind['query']}, id {kind['id']}, distance double"
    heads = v.orderBy(F.xxhash64("id"), "v").limit(4 * pivots).select("v").collect()  # some more, as vectors may be equal
    points = np.array(list(dict.fromkeys(tuple(r["v"]) for r in heads))[:pivots], np.float64)
    if not len(points):
        return spark.createDataFrame([], f"query_id {kind['query']}, rank long, id {kind['id']}, distance double")
    placed = _assigned(v, points)
    nth = F.row_number().over(W.partitionBy("cell").orderBy("far"))
    heads = placed.select("cell", "far").withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    cells = sizes.join(heads, "cell").orderBy("cell").toPandas()  # a row per pivot, k distances each
    wanted = written(_asked(q, points, cells, k, shift).withColumn("row", F.monotonically_increasing_id()), "asked")
    counts = wanted.groupBy("cell").agg(F.count("*").alias("m"))
    cuts = F.broadcast(sizes.join(counts, "cell").select("cell", F.ceil(F.col("n") / block).alias("vb"), F.ceil(F.col("m") / asked).alias("qb")))  # a row per pivot
    left = placed.join(cuts, "cell").select("cell", (F.col("row") % F.col("vb")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("j"), "id", "v")
    right = wanted.join(cuts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)).alias("i"), (F.col("row") % F.col("qb")).alias("j"), "query", "v")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": b["query"][:0], "id": a["id"][:0], "distance": np.zeros(0)})
        a = a.sort_values("id", kind="stable")
        x, keys, out = _matrix(a["v"]), a["id"].to_numpy(), []
        norms = (x * x).sum(1)
        for lo in range(0, len(b), 256):
            some = b.iloc[lo : lo + 256]
            m = _matrix(some["v"])
            d = _squares(m, x)
            kth = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            loose = shift + 4 * SLACK * (norms.max() + (m * m).sum(1))
            for i, key in enumerate(some["query"].to_numpy()):
                near = np.flatnonzero(d[i] <= kth[i] + loose[i])
                exact = ((x[near] - m[i]) ** 2).sum(1)
                exact = exact if digits is None else np.round(exact, digits)
                best = np.argsort(exact, kind="stable")[:k]  # rows lie in the order of their ids
                out.append(pd.DataFrame({"query": key, "id": keys[near[best]], "distance": exact[best]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(compare, schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "id", "distance")
