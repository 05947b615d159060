"""Index maintenance: snapshot diff, priorities, a deduplicating queue, batches and upserts.

Joins by path are hinted to be merged: a broadcast table of paths is held by the driver and by every task, and grows with the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..sources.scratch import written

#: Versions that a manifest row must carry to count as current.
AST_VERSION, RAG_VERSION = 1, 1


def manifest_diff(snapshot: DataFrame, manifest: DataFrame, ast_version: int = AST_VERSION, rag_version: int = RAG_VERSION) -> DataFrame:
    """(path, status): NEW, CHANGED, UNCHANGED or DELETED, by a full outer join on the path.

    snapshot: path, mtime, size. manifest: path, mtime, size, ast_version, rag_version, has_chunk.
    """
    s = snapshot.select("path", F.col("mtime").alias("s_mtime"), F.col("size").alias("s_size"), F.lit(True).alias("seen"))
    m = manifest.withColumn("known", F.lit(True))
    same = F.col("s_mtime").eqNullSafe(F.col("mtime")) & F.col("s_size").eqNullSafe(F.col("size"))
    current = F.col("ast_version").eqNullSafe(F.lit(ast_version)) & F.col("rag_version").eqNullSafe(F.lit(rag_version)) & F.col("has_chunk")
    status = F.when(F.col("known").isNull(), "NEW").when(F.col("seen").isNull(), "DELETED").when(same & current, "UNCHANGED").otherwise("CHANGED")
    return s.hint("merge").join(m, "path", "full").select("path", status.alias("status"), "s_mtime", "s_size")


def startup_queue(diff: DataFrame, high: int = 10, batch: int = 6) -> DataFrame:
    """NEW and CHANGED files by newest mtime: rank, priority (the first ``high`` are HIGH) and the batch they are taken in."""
    todo = diff.filter(F.col("status").isin("NEW", "CHANGED"))
    out = numbered(todo, F.col("s_mtime"), F.col("path"), name="rank", descending=True)
    return out.select("path", "status", "rank", F.when(F.col("rank") <= high, "HIGH").otherwise("LOW").alias("priority"), F.floor((F.col("rank") - 1) / batch).cast("long").alias("batch"))


def queued(jobs: DataFrame) -> DataFrame:
    """One job per path of (path, priority, seq, ...): a HIGH job is never replaced by a LOW one, else the newest wins."""
    others = [c for c in jobs.columns if c != "path"]
    job = F.struct((F.col("priority") == "HIGH").alias("is_high"), "seq", *[c for c in others if c != "seq"])
    return jobs.groupBy("path").agg(F.max(job).alias("job")).select("path", *[F.col(f"job.{c}").alias(c) for c in others])


def batches(queue: DataFrame, size: int = 6) -> DataFrame:
    """The whole schedule: HIGH first, then first come; ``size`` jobs a batch. Priority and arrival make one numeric key."""
    top = queue.agg(F.max("queued_at").alias("m"), F.min("queued_at").alias("l")).first()
    span = (top["m"] - top["l"] + 1) if top["m"] is not None else 1
    key = F.when(F.col("priority") == "HIGH", 0).otherwise(1) * F.lit(float(span)) + (F.col("queued_at") - F.lit(top["l"] or 0))
    out = numbered(queue, key, F.col("path"), name="place")
    return out.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))


def upserted(base: DataFrame, updates: DataFrame, key: str, accepted: Column | None = None) -> DataFrame:
    """``base`` with rows replaced or added by ``updates``; an update that isn't accepted leaves the old row."""
    good = updates if accepted is None else updates.filter(accepted)
    return base.hint("merge").join(good.select(key), key, "left_anti").unionByName(good)


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.hint("merge").join(keys.select(key), key, "left_anti")


def is_vector(vector: str) -> Column:
    """An embedding that isn't all zero; a failed one is, and then the old row stays."""
    return F.exists(vector, lambda x: x != 0)


def hydrated(manifest: DataFrame, ast_version: int = AST_VERSION, rag_version: int = RAG_VERSION) -> DataFrame:
    """Manifest rows that can serve as graph nodes: current versions and a chunk."""
    return manifest.filter((F.col("ast_version") == ast_version) & (F.col("rag_version") == rag_version) & F.col("has_chunk"))


def applied(jobs: DataFrame, nodes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes after deletes, paths to extract) of a batch of jobs: a deleted or missing file leaves, others are extracted anew."""
    gone = jobs.hint("merge").join(sources.select("path"), "path", "left_anti").select("path").unionByName(jobs.filter("reason = 'DELETED'").select("path")).distinct()
    return deleted(nodes, gone, "path"), jobs.select("path").distinct().hint("merge").join(gone, "path", "left_anti")


@dataclass
class Startup:
    """What a start finds: nodes that can serve at once, paths to forget, and the queue of files to index."""

    nodes: DataFrame
    gone: DataFrame
    queue: DataFrame


def reconciled(snapshot: DataFrame, manifest: DataFrame, ast_version: int = AST_VERSION, rag_version: int = RAG_VERSION) -> Startup:
    """A manifest against the files found at a start: hydrated rows of files that are still there serve, deleted ones go, new and changed ones queue."""
    diff = manifest_diff(snapshot, manifest, ast_version, rag_version)
    gone = diff.filter("status = 'DELETED'").select("path")
    return Startup(deleted(hydrated(manifest, ast_version, rag_version), gone, "path"), gone, startup_queue(diff))


@dataclass
class Indexed:
    """The three stores after a batch of jobs."""

    manifest: DataFrame
    nodes: DataFrame
    vectors: DataFrame


def indexed(jobs: DataFrame, manifest: DataFrame, nodes: DataFrame, vectors: DataFrame, rows: DataFrame, vector: str = "vector") -> Indexed:
    """Run a batch of jobs (path, reason) against manifest, graph nodes and vectors, all by path.

    rows: what was extracted from the sources of the batch, a row per file that is there and parses, with the columns of
    all three stores. Jobs that say DELETED and files without such a row leave all stores; the others replace their rows,
    but a failed (all zero) vector leaves the old one.

    Rows of live jobs are written once, and so are the paths that leave a store: a chain of joins by one key would else
    stay in one stage, where every task holds all of their sorts at once.
    """
    each = jobs.groupBy("path").agg(F.max(F.col("reason") == "DELETED").alias("dead"))
    rows = written(rows.hint("merge").join(each.filter(~F.col("dead")).select("path"), "path", "left_semi"), "indexed-rows")
    named = written(each.select("path"), "indexed-paths")
    failed = rows.groupBy("path").agg(F.max(F.coalesce(is_vector(vector), F.lit(False))).alias("good")).filter("NOT good").select("path")
    put = lambda base, out, new: deleted(base, out, "path").unionByName(new.select(*base.columns))
    return Indexed(put(manifest, named, rows), put(nodes, named, rows), put(vectors, deleted(named, failed, "path"), rows.filter(is_vector(vector))))
