"""End to end: extract a source tree, build its graph, retrieve context for a batch of tasks and put it into their conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators import extraction, graph, messages, retrieval
from ..operators.nearest import nearest

BUDGET = 16_384
CONFIDENCE = 0.85


@dataclass
class Project:
    """Tables of one indexed tree. chunks: pos and the extracted record; edges: src, pos, dst; sources: path, content."""

    chunks: DataFrame
    edges: DataFrame
    sources: DataFrame

    @classmethod
    def of(cls, sources: DataFrame) -> Project:
        chunks = extraction.extracted(sources)
        chunks = chunks.withColumn("pos", F.xxhash64("path") & F.lit((1 << 62) - 1)) if "pos" not in sources.columns else chunks.join(sources.select("path", "pos"), "path")
        imports = chunks.select(F.concat(F.lit("/"), "path").alias("file_path"), F.posexplode("imports").alias("pos", "specifier"))
        files = sources.select(F.concat(F.lit("/"), "path").alias("path"))
        edges = graph.graph_edges(imports, files, files)
        return cls(chunks, edges.select(F.expr("substr(src, 2)").alias("src"), "pos", F.expr("substr(dst, 2)").alias("dst")), sources)

    def symbols(self) -> DataFrame:
        c = self.chunks.withColumnRenamed("path", "file_path")
        each = lambda column, kind: c.select("pos", "file_path", F.lit(kind).alias("kind"), F.explode(F.transform(column, lambda x: x["name"])).alias("name"))
        return each("functions", "function").unionByName(each("components", "component")).unionByName(each("types", "type")).unionByName(retrieval.file_symbols(c))

    def by_file(self) -> DataFrame:
        """(pos, file_path, symbols) for an index: the same symbols as arrays of names by kind."""
        each = lambda column, kind: F.struct(F.lit(kind).alias("kind"), F.transform(column, lambda x: x["name"]).alias("names"))
        own = F.struct(F.lit("file").alias("kind"), F.array(stem("path")).alias("names"))
        return self.chunks.select("pos", F.col("path").alias("file_path"), F.array(each("functions", "function"), each("components", "component"), each("types", "type"), own).alias("symbols"))

    def status(self) -> DataFrame:
        """One row: files, edges and symbols."""
        n = lambda df, name: df.agg(F.count("*").alias(name))
        return n(self.sources, "files").join(n(self.edges, "edges")).join(n(self.symbols(), "symbols"))  # three single rows


def lexical(project: Project, tasks: DataFrame) -> DataFrame:
    """(task_id, file_path, nth): files that tasks name, with their direct dependencies."""
    top = retrieval.top_scored(tasks, retrieval.symbol_index(project.by_file()))
    return retrieval.with_dependencies(top, project.edges, project.chunks.select(F.col("path").alias("file_path")))


def contexts(project: Project, tasks: DataFrame, hits: DataFrame | None = None, *, score=None, budget: int = BUDGET, active_path: str | None = None, threshold: float = 0.55) -> DataFrame:
    """(task_id, ast_context, tokens, files, think, confidence) for tasks (task_id, task).

    hits: results of a vector search, (task_id, pos, file_path, content). score: a UDF (task, text); without one the
    candidates keep their order. Whole files stand for the best three, signatures for the rest, as far as the budget goes.
    """
    chosen = lexical(project, tasks).join(project.chunks.withColumnRenamed("path", "file_path").drop("pos"), "file_path").withColumnRenamed("nth", "pos")
    ast = retrieval.chunk_candidates(chosen, active_path)
    both = ast if hits is None else retrieval.candidate_union(ast, retrieval.vector_candidates(hits))
    scores = None if score is None else both.join(tasks, "task_id").select("task_id", "pos", score("task", "text").alias("score"))
    chunks = retrieval.tiered_chunks(retrieval.full_content(retrieval.reranked(both, scores), project.sources))
    if active_path:
        files = project.sources.select("path", "content").join(project.chunks.select("path", "pos"), "path")
        chunks = chunks.unionByName(retrieval.active_chunk(tasks.select("task_id", F.lit(active_path).alias("active_path")), files))
    taken = retrieval.packed(chunks, budget).join(chunks.select("task_id", "id", "pos", "text"), ["task_id", "id", "pos"])
    joined = taken.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n").alias("ast_context"), F.sum("tokens").alias("tokens"))
    about = chosen.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file_path"))), lambda x: F.element_at(F.split(x["file_path"], "/"), -1)).alias("files"), F.max("cyclomatic").alias("cyclomatic"))
    out = tasks.select("task_id").join(joined, "task_id", "left").join(about, "task_id", "left")
    return out.select("task_id", F.coalesce("ast_context", F.lit("")).alias("ast_context"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), retrieval.thinks(F.col("cyclomatic"), threshold).alias("think"), F.lit(CONFIDENCE).alias("confidence"))


def answered(project: Project, conversations: DataFrame, *, budget: int = BUDGET, tag: str = "context", **how) -> DataFrame:
    """Conversations (conv_id, turn, role, content) as they would be sent on: engineered, with context, within the budget."""
    tasks = messages.task_text(conversations).select(F.col("conv_id").alias("task_id"), "task")
    ctx = contexts(project, tasks, budget=budget, **how)
    text = messages.context_message(F.col("think"), F.col("ast_context"), F.lit(None).cast("string"), tag)
    with_context = messages.injected(messages.kept_messages(conversations), ctx.select(F.col("task_id").alias("conv_id"), text.alias("context")))
    return messages.trimmed(with_context, budget)


def search(vectors: DataFrame, tasks: DataFrame, k: int = 20) -> DataFrame:
    """(task_id, pos, file_path, content): the k nearest chunks of each task (task_id, vector), exactly, ties by path; any number of tasks."""
    best = nearest(vectors, tasks, k, id_col="file_path", vector_col="vector", query_id="task_id", query_vector="vector", digits=None)
    found = best.select(F.col("query_id").alias("task_id"), F.col("rank").alias("pos"), F.col("id").alias("file_path"))
    return found.join(vectors.select("file_path", "content"), "file_path").select("task_id", "pos", "file_path", "content")  # contents of what was found only
