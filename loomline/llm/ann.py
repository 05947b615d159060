"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced halving of a bounded sample. Every vector goes to its nearest centroid's list and, near a
border, to further ones as well. A query walks a graph of centroids in memory, nearest first, and keeps the lists whose
centroids lie within a ratio of the nearest one's distance; within these lists the search is exact. Neighbouring lists
make a region, so that a vector and a query are sent once per region and not once per list. A query that would take most
lists (vectors without structure have no near ones) takes the primary list of every vector instead: each is met once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ship, tidy, written


@dataclass(frozen=True)
class Settings:
    sample: int = 65_536  #: vectors that centroids are fitted on, at most
    sample_bytes: int = 64_000_000  #: and bytes of them; lists are an eighth of the sample at most, then they grow in length
    list_size: int = 512  #: vectors of a list aimed at
    border: float = 1.06  #: a vector joins the lists whose centroid is at most this much further than its nearest
    replicas: int = 4
    ratio: float = 1.4  #: a query searches the lists whose centroid is at most this much further than its nearest
    least_vectors: int = 2048  #: and goes on till its lists hold so many
    most: float = 0.5  #: a query that takes more than this share of the lists takes all vectors once, by their primary lists
    degree: int = 12
    region: int = 16  #: lists of a region
    block_bytes: int = 8_000_000  #: of vectors, or of queries, of a region that meet in one task


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def halved(v: np.ndarray, leaves: int) -> np.ndarray:
    """Centroids of ``leaves`` parts of equal size (to one): each cut is at the median along the line between two means."""
    out, todo = [], [(np.arange(len(v)), min(leaves, len(v)))]
    while todo:
        rows, n = todo.pop()
        if n <= 1:
            c = v[rows].mean(axis=0)
            out.append(c / np.linalg.norm(c) if c.any() else v[rows[0]])
            continue
        own = v[rows]
        far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        a, b = far, own[((own - far) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            left = own @ (a - b) > (a @ a - b @ b) / 2
            if left.all() or not left.any():
                break
            a, b = own[left].mean(axis=0), own[~left].mean(axis=0)
        order = np.argsort(own @ (b - a), kind="stable")
        cut = len(rows) * (n // 2) // n
        todo += [(rows[order[cut:]], n - n // 2), (rows[order[:cut]], n // 2)]
    return np.stack(out)


class CentroidGraph:
    """Each centroid with its nearest others, and a ring through all so that every one can be reached."""

    def __init__(self, centroids: np.ndarray, sizes: np.ndarray, s: Settings):
        self.c, self.sizes, self.s = centroids, sizes, s
        n, near = len(centroids), []
        for lo in range(0, n, 512):
            d = -centroids[lo : lo + 512] @ centroids.T
            near.append(np.argpartition(d, min(s.degree, n - 1), axis=1)[:, : s.degree + 1])
        near = np.concatenate(near)
        self.links = [np.unique([*near[i], (i + 1) % n, (i - 1) % n]) for i in range(n)]
        apart = [np.sqrt(max(0.0, 2 - 2 * float(np.partition(centroids[self.links[i]] @ centroids[i], -2)[-2]))) for i in range(0, n, max(1, n // 256)) if len(self.links[i]) > 1]
        self.least = float(np.median(apart)) / 2 if apart else 0.0  # a query on top of a centroid still looks around
        self.entry = int((centroids @ unit(centroids.mean(axis=0) + 1e-12)).argmax())

    def search(self, q: np.ndarray) -> list[int]:
        """Lists for a unit vector: nearest first, by the ratio of distances, then till enough vectors are at hand."""
        far = lambda i: np.sqrt(np.maximum(0.0, 2 - 2 * (self.c[i] @ q)))
        seen = np.zeros(len(self.c), bool)
        seen[self.entry] = True
        best = max(self.least, float(far([self.entry])[0]))
        heap, got, held = [(best, self.entry)], [], 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > self.s.ratio * best and held >= self.s.least_vectors and len(got) >= self.s.degree:
                break
            got.append((d, i))
            held += int(self.sizes[i])
            new = self.links[i][~seen[self.links[i]]]
            if len(new):
                seen[new] = True
                ds = far(new)
                best = max(self.least, min(best, float(ds.min())))
                for x, j in zip(ds.tolist(), new.tolist(), strict=True):
                    heapq.heappush(heap, (x, j))
        got.sort()
        out, held = [], 0
        for d, i in got:
            if d > self.s.ratio * best and held >= self.s.least_vectors:
                break
            out.append(i)
            held += int(self.sizes[i])
        return out


def _packed(rows: DataFrame, cols: list[str], vector: str) -> DataFrame:
    """``cols`` and the vector as bytes of doubles, over a power of two that brings its largest component below 1.

    Cosines stay what they are to the last bit, and squares of very large or very small components neither overflow nor vanish.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(len(cols))
            flat, ends = np.asarray(v.flatten(), "<f8"), np.concatenate([[0], np.cumsum(np.asarray(v.value_lengths()))])
            if len(flat):
                exponents = np.frexp(np.maximum.reduceat(np.abs(flat), ends[:-1]))[1]
                flat = np.ldexp(flat, -np.repeat(exponents, np.diff(ends)))
            data = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(cols))), pa.array(data, pa.binary())], names=[*cols, "vec"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cols)
    return rows.select(*cols, vector).mapInArrow(tidy(run), f"{schema}, vec binary")


def _matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), -1)


def _pairs(vectors: pa.Table, queries: pa.Table, region: int, span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of vectors, rows of queries) that meet: list by list, and all primary vectors with the queries that take them all."""
    ends = lambda t: np.repeat(np.arange(t.num_rows), np.asarray(t["lists"].combine_chunks().value_lengths()))
    flat = lambda t: np.asarray(t["lists"].combine_chunks().flatten())
    (v_list, v_row), (q_list, q_row) = (flat(vectors), ends(vectors)), (flat(queries), ends(queries))
    out = [(v_row[v_list == i], q_row[q_list == i]) for i in np.intersect1d(v_list, q_list).tolist()]
    broad = np.flatnonzero(np.asarray(queries["broad"].combine_chunks().to_numpy(zero_copy_only=False)))
    own = np.flatnonzero(np.asarray(vectors["primary"]) // span == region) if region >= 0 else np.arange(vectors.num_rows)
    return [*out, (own, broad)] if len(broad) and len(own) else out


def _top(k: int, span: int):
    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """The k nearest classes of each query within one block of a region. Whatever rounding could put among them is compared exactly."""
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if vectors.num_rows and queries.num_rows:
            v, ids, qs, q_ids = _matrix(vectors["vec"]), np.asarray(vectors["cid"]), _matrix(queries["vec"]), np.asarray(queries["query_id"])
            norm, q_norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((qs * qs).sum(axis=1))
            at_q, at_v = [], []
            for rows, asked in _pairs(vectors, queries, vectors["region"][0].as_py(), span):
                u, near = v[rows] / norm[rows, None], min(k, len(rows))
                step = max(1, 1_000_000 // len(rows))
                for lo in range(0, len(asked), step):
                    part = asked[lo : lo + step]
                    rough = (qs[part] / q_norm[part, None]) @ u.T
                    least = np.partition(rough, len(rows) - near, axis=1)[:, len(rows) - near]
                    i, j = np.nonzero(rough >= least[:, None] - 1e-10)
                    at_q.append(part[i])
                    at_v.append(rows[j])
            if at_q:
                code = np.unique(np.concatenate(at_q).astype(np.int64) * len(v) + np.concatenate(at_v))
                i, j = code // len(v), code % len(v)
                exact = np.concatenate([(v[j[lo : lo + 8192]] * qs[i[lo : lo + 8192]]).sum(axis=1) for lo in range(0, len(i), 8192)])
                exact = np.clip(exact / (norm[j] * q_norm[i]), -1.0, 1.0)
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                out = [q_ids[i[keep]], ids[j[keep]], exact[keep]]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "cid": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return meet


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, emb) of the rows that take part: with an id, and a vector without null or non-finite components that isn't zero."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("emb"))
    bad = F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("emb").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("emb", lambda x: x != 0))


def assigned(vectors: np.ndarray, c: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list) of every posting of unit vectors, and each row's primary list."""
    d = np.sqrt(np.maximum(0.0, 2 - 2 * vectors @ c.T))
    m = min(s.replicas, len(c))
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    own = np.take_along_axis(d, near, axis=1)
    at, which = np.nonzero(own <= own.min(axis=1, keepdims=True) * s.border)
    return at, near[at, which], near[np.arange(len(near)), own.argmin(axis=1)]


def taken(graph: CentroidGraph, q: np.ndarray) -> tuple[list[int], bool]:
    """The lists of a unit query, and whether it takes all vectors by their primary lists instead."""
    lists = graph.search(q)
    return ([], True) if len(lists) > graph.s.most * len(graph.c) else (lists, False)


def _regions(at: np.ndarray, lists: np.ndarray, span: int) -> tuple[list[int], list[int], list[list[int]]]:
    """One (row, region, its lists) for each region that a row has lists in."""
    order = np.lexsort((lists, at))
    at, lists = at[order], lists[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (lists[1:] // span != lists[:-1] // span)])) if len(at) else np.zeros(0, int)
    return at[new].tolist(), (lists[new] // span).tolist(), [x.tolist() for x in np.split(lists, new[1:])] if len(at) else []


def nearest(table: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """For each row whose id is divisible by ``every`` its k nearest other rows found: query_id, rank, vec_id, score.

    Score is the cosine in double precision, -1 to 1; ties go to the smaller id. Equal vectors are one class with its k+1
    smallest ids, exactly what ties need, so a vector that a third of the rows repeat is searched once. A row is told by
    its id: rows that share the query's id are its own, and of repeated ids the first found counts. Vectors are compared
    with those of their own length; lists are fitted for the commonest length, the others are searched whole. Fewer
    candidates than k give fewer rows; tables without usable vectors give none. Further columns are ignored.
    """
    s, spark = settings, table.sparkSession
    ship(spark)
    rows = usable(table, id_col, vector_col)
    nth = F.row_number().over(W.partitionBy("emb").orderBy("id"))  # limited to k+1 rows before the shuffle, too
    classes = rows.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("emb").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(_packed(classes, ["cid", "ids"], "emb"), "ann-classes")
    sizes = {r["d"]: r["count"] for r in classes.groupBy((F.octet_length("vec") / 8).cast("int").alias("d")).count().collect()}  # a row per length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    dim = max(sizes, key=lambda d: (sizes[d], -d))
    n, most = sizes[dim], max(1, min(s.sample, s.sample_bytes // (8 * dim)))
    main = classes.filter(F.octet_length("vec") == 8 * dim)
    picked = main.select("vec") if n <= most else main.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int(most / n * (1 << 20)) + 1).select("cid", "vec").orderBy("cid").limit(most).select("vec")
    sample = unit(_matrix(picked.toArrow()["vec"]))
    centroids = halved(sample, max(1, min(len(sample) // 8, -(-n // s.list_size))))
    del sample
    sent = spark.sparkContext.broadcast(centroids)  # an eighth of the sample at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lengths = np.asarray(pc.binary_length(part.column(1))) // 8
                fit = np.flatnonzero(lengths == dim)
                at, lists, primary = assigned(unit(_matrix(part.column(1).take(pa.array(fit)))), c, s) if len(fit) else (np.zeros(0, int),) * 3
                row, region, own = _regions(at, lists, s.region)
                first = primary[row].tolist() if row else []
                others = np.flatnonzero(lengths != dim).tolist()
                row = [*fit[row].tolist(), *others]
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([*region, *(-int(lengths[i]) for i in others)], pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array([*own, *([] for _ in others)], pa.list_(pa.int32())), pa.array([*first, *(-1 for _ in others)], pa.int32())], names=["region", "cid", "vec", "lists", "primary"])

    posted = written(classes.select("cid", "vec").mapInArrow(tidy(assign), "region int, cid long, vec binary, lists array<int>, primary int"), "ann-lists")
    in_list = {r["list"]: r["count"] for r in posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}  # a row per list
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids, np.array([in_list.get(i, 0) for i in range(len(centroids))]), s))
    n_regions = -(-len(centroids) // s.region)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, region, own, broad = [], [], [], []
                for i, raw in enumerate(part.column(1).to_pylist()):
                    q = np.frombuffer(raw, "<f8")
                    lists, everything = taken(graph.value, unit(q)) if len(q) == dim else ([], True)
                    to = _regions(np.zeros(len(lists), int), np.array(lists, int), s.region)[1:] if not everything else ([-len(q)] if len(q) != dim else list(range(n_regions)), None)
                    region += to[0]
                    own += to[1] or [[]] * len(to[0])
                    row += [i] * len(to[0])
                    broad += [everything] * len(to[0])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(own, pa.list_(pa.int32())), pa.array(broad, pa.bool_())], names=["region", "query_id", "vec", "lists", "broad"])

    queries = rows.filter(F.col("id") % every == 0).dropDuplicates(["id"]).withColumnRenamed("id", "query_id")
    routed = written(_packed(queries, ["query_id"], "emb").mapInArrow(tidy(route), "region int, query_id long, vec binary, lists array<int>, broad boolean"), "ann-queries")

    of = lambda t: {r["region"]: r["count"] for r in t.groupBy("region").count().collect()}  # noqa: E731  a row per region
    held, asked, block = of(posted), of(routed), lambda r: max(1, s.block_bytes // (8 * (dim if r >= 0 else -r)))
    parts = F.broadcast(spark.createDataFrame([(r, -(-held[r] // block(r)), -(-asked[r] // block(r))) for r in sorted(held) if r in asked] or [(0, 1, 1)], "region int, v_parts int, q_parts int"))
    share = lambda col, parts: F.pmod(F.xxhash64(col), F.col(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = posted.join(parts, "region").select("region", share("cid", "v_parts").alias("v"), all_of("q_parts").alias("q"), "cid", "vec", "lists", "primary")
    right = routed.join(parts, "region").select("region", share("query_id", "q_parts").alias("q"), all_of("v_parts").alias("v"), "query_id", "vec", "lists", "broad")
    met = left.groupBy("region", "v", "q").cogroup(right.groupBy("region", "v", "q")).applyInArrow(_top(k + 1, s.region), "query_id long, cid long, score double")
    met = met.groupBy("query_id", "cid").agg(F.max("score").alias("score"))  # a border vector is met in several regions
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "cid"))
    found = met.withColumn("r", best).filter(F.col("r") <= k + 1).join(classes.select("cid", "ids"), "cid").select("query_id", "score", F.explode("ids").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
