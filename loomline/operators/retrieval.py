"""Retrieval: keyword scores, exact vector search, candidates, reranking, tiers and greedy packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..functions.text import base_name, chunk_tokens, stem
from ..sources.scratch import ship, written

#: Symbol names too common to mean anything (fixed values).
GENERIC = ("get", "set", "run", "app", "use", "init", "load", "data", "item", "fn", "cb", "el", "on", "to", "of", "is", "has", "do", "go", "id", "ok", "no")
WEIGHTS = {"function": 3, "component": 3, "type": 2, "file": 2}


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, query: Sequence[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(id, distance) of the k vectors nearest to one query: one scan, a heap of k rows per task, no shuffle of the table. A zero query finds nothing."""
    if not any(query):
        return vectors.select(id_col, F.lit(0.0).alias("distance")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(distance(F.col(vector_col).cast("array<double>"), q), digits).alias("distance")).orderBy("distance", id_col).limit(k)


def file_symbols(files: DataFrame) -> DataFrame:
    """Each file of (pos, file_path) as a symbol: its name without suffix."""
    return files.select("pos", "file_path", F.lit("file").alias("kind"), stem("file_path").alias("name"))


def _weight(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[kind]


def _spelled(tasks: DataFrame, lengths: Sequence[int], keys: DataFrame) -> DataFrame:
    """(task_id, key): the distinct substrings of each task that have one of the lengths and are among the keys."""
    low = tasks.select("task_id", F.lower("task").alias("task")).filter(F.length("task") >= 2)
    starts = low.select("task_id", "task", F.explode(F.sequence(F.lit(1), F.length("task") - 1)).alias("at"))
    sizes = starts.select("task_id", "task", "at", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n"))
    every = sizes.filter(F.col("n") <= F.length("task") - F.col("at") + 1).select("task_id", F.substring("task", F.col("at"), F.col("n")).alias("key"))
    return every.join(keys, "key", "left_semi").distinct()


def _met(tasks: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """(name, task_id): the names (name, lower case and distinct) that stand in each task; those longer than a key are looked up in full."""
    keyed = written(names.withColumn("key", F.substring("name", 1, longest)), "task-names")
    lengths = sorted(r["n"] for r in keyed.select(F.length("key").alias("n")).distinct().collect())  # ``longest`` rows at most
    hit = keyed.join(_spelled(tasks, lengths, keyed.select("key").distinct()), "key").select("name", "task_id")
    low = tasks.select("task_id", F.lower("task").alias("task"))
    long = hit.filter(F.length("name") > longest).join(low, "task_id").filter(F.col("task").contains(F.col("name"))).select("name", "task_id")
    return written(hit.filter(F.length("name") <= longest).unionByName(long).distinct(), "task-met")


#: Sizes of one group of ``task_scores``: names of files, files, and tasks.
GROUP_NAMES, GROUP_FILES, GROUP_TASKS = 250_000, 4_000, 200
_ONE = float(1 << 24)  # a sum holds the weight above these bits, and below them the number of names


def _product(names: pa.Table, met: pa.Table, k: int | None, schema: pa.Schema) -> pa.Table:
    """Scores of one group: names (file_path, pos, name, weight) of some files times the names (name, task_ids) that stand in some tasks."""
    lists, file_of = met["task_ids"].combine_chunks(), names["file_path"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    known = pc.index_in(names["name"].combine_chunks(), met["name"].combine_chunks()).cast("float64").to_numpy(zero_copy_only=False)
    tasks = pc.list_flatten(lists).dictionary_encode()
    table = np.zeros((len(met), len(tasks.dictionary)))
    table[np.repeat(np.arange(len(met)), pc.list_value_length(lists).to_numpy()), tasks.indices.to_numpy()] = 1.0
    own = ~np.isnan(known)
    column, weight = known[own].astype(np.int64), pc.fill_null(names["weight"], 0).to_numpy()[own] * _ONE + 1
    frame = pd.DataFrame({"file": file_of[own], "pos": pc.fill_null(names["pos"], -1).to_numpy()[own], "at": np.flatnonzero(own)})
    unit = frame.groupby(["file", "pos"], sort=True).ngroup().to_numpy()  # a file may stand at several places
    order = np.argsort(unit, kind="stable")
    unit, column, weight, at = unit[order], column[order], weight[order], frame["at"].to_numpy()[order]
    count = int(unit[-1]) + 1 if len(unit) else 0
    first = at[np.searchsorted(unit, np.arange(count))]
    used, column = np.unique(column, return_inverse=True)
    table, step, found = table[used], max(16, 4_000_000 // max(1, len(used))), []
    for lo in range(0, count, step):
        here = slice(*np.searchsorted(unit, [lo, lo + step]))
        dense = np.zeros((min(step, count - lo), len(used)))
        np.add.at(dense, (unit[here] - lo, column[here]), weight[here])
        sums = dense @ table
        row, task = np.nonzero(sums)
        found.append((row + lo, task, sums[row, task]))
    row, task, sums = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    score = (sums // _ONE).astype(np.int64)
    if frame["file"].nunique() < count:  # then places of one file are put together
        each = pd.DataFrame({"file": file_of[first][row], "task": task, "row": row, "score": score}).groupby(["file", "task"], sort=False).agg(row=("row", "min"), score=("score", "sum")).reset_index()
        row, task, score = each["row"].to_numpy(), each["task"].to_numpy(), each["score"].to_numpy()
    if k is not None and len(score):
        order = np.lexsort((-score, task))
        place = np.arange(len(order)) - np.searchsorted(task[order], task[order])
        least = np.zeros(table.shape[1], np.int64)
        least[task[order][place == k - 1]] = score[order][place == k - 1]
        keep = score >= least[task]
        row, task, score = row[keep], task[keep], score[keep]
    at = pa.array(first[row])
    columns = [tasks.dictionary.take(pa.array(task)), names["file_path"].combine_chunks().take(at), names["pos"].combine_chunks().take(at), pa.array(score, mask=score == 0)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def task_scores(tasks: DataFrame, symbols: DataFrame, longest: int = 40, k: int | None = None) -> DataFrame:
    """(task_id, file_path, pos, score): weights of a file's symbols whose name stands in the task, repeated ones counted again.

    symbols: pos, file_path, kind, name. Containment becomes an equality: a task is spelled out into its substrings of the
    lengths that names have (up to ``longest``), and a name is looked up by its first ``longest`` characters; longer names
    are then checked in full. So only distinct names meet tasks, and of the files' names only those that stand in some task are shuffled.
    Scores are a product of two sparse tables, files by names and names by tasks: a group has some files and some tasks, and is multiplied by itself. The
    result has a row for each task and file that meet. With ``k`` files that have ``k`` better ones in their own group for a task may be
    left out, which ``top_files`` doesn't notice; for the best files of each task, ``top_scored`` looks at few files only.
    """
    useful = symbols.filter((F.length("name") >= 2) & ~F.lower("name").isin(*GENERIC)).withColumn("name", F.lower("name"))
    met = _met(tasks, useful.select("name").distinct(), longest)
    named = useful.join(met.select("name").distinct(), "name", "left_semi").groupBy("file_path", "pos", "name").agg(F.sum(_weight(F.col("kind"))).cast("long").alias("weight"))
    named = written(named, "task-files")
    n = named.agg(F.count("*").alias("names"), F.approx_count_distinct(F.struct("file_path", "pos")).alias("files")).first()
    groups = max(1, n["names"] // GROUP_NAMES, n["files"] // GROUP_FILES)
    blocks = max(1, met.select("task_id").distinct().count() // GROUP_TASKS)
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = named.withColumn("group", F.pmod(F.xxhash64("file_path"), F.lit(groups)).cast("int")).select("*", every(blocks).alias("block"))
    lists = met.withColumn("block", F.pmod(F.xxhash64("task_id"), F.lit(blocks)).cast("int")).groupBy("block", "name").agg(F.collect_list("task_id").alias("task_ids"))  # tasks of one block
    right = lists.select("*", every(groups).alias("group"))
    types = {"task_id": tasks.schema["task_id"].dataType, "file_path": symbols.schema["file_path"].dataType, "pos": symbols.schema["pos"].dataType, "score": T.LongType()}
    schema = T.StructType([T.StructField(c, kind) for c, kind in types.items()])
    out = to_arrow_schema(schema)
    ship(tasks.sparkSession)
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(lambda a, b: _product(a, b, k, out), schema)


def symbol_index(files: DataFrame) -> DataFrame:
    """(file_path, pos, symbols, bound) of files (pos, file_path, symbols), symbols being an array of (kind, names): the sum of all weights bounds any task's score. Written, to be read by ``top_scored``."""
    bound = F.aggregate("symbols", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(_weight(x["kind"]) * F.size(x["names"]), F.lit(0)))
    return written(files.select("file_path", "pos", "symbols").withColumn("bound", bound), "symbol-index")


def top_scored(tasks: DataFrame, index: DataFrame, k: int = 5, first: int = 512, more: int = 8, longest: int = 40) -> DataFrame:
    """The k best files per task, as ``top_files`` of ``task_scores`` gives them, over a ``symbol_index``: few files are looked into.

    A threshold algorithm in rounds: about ``first`` files with the greatest bounds are scored for all tasks, then ``more`` times as many, and
    so on. A task whose k-th score reaches the bounds of all files that are left is done; the others go on, at last over all files.
    Where rounds are cut is approximate, what they give isn't. Scores are made for the files of a round and the tasks still open only.
    """
    n = index.count()
    sizes = []
    while (first * more ** len(sizes)) < n:
        sizes.append(first * more ** len(sizes))
    cuts = index.agg(F.percentile_approx("bound", [1 - x / n for x in sizes], 100_000)).first()[0] if sizes else []
    cuts = [*sorted(set(cuts), reverse=True), None]  # bounds of the least file of each round
    left, best, above = tasks.select("task_id", "task").repartition("task_id"), None, None
    for cut in cuts:
        files = index if above is None else index.filter(F.col("bound") < above)
        files = files if cut is None else files.filter(F.col("bound") >= cut)
        each = files.select("file_path", "pos", F.explode("symbols").alias("s")).select("file_path", "pos", "s.kind", F.explode("s.names").alias("name"))
        scores = task_scores(left, each, longest, k)
        best = written(top_files(scores if best is None else scores.unionByName(best.drop("rank")), k), "task-best")
        if cut is not None:
            done = best.filter((F.col("rank") == k) & (F.col("score") >= cut)).select("task_id")
            left = written(left.join(done, "task_id", "left_anti"), "task-left")
            if left.isEmpty():
                break
            left = left.repartition("task_id")
        above = cut
    return best


def top_files(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best files per task; ties keep the order of the graph."""
    nth = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("score"), "pos", "file_path"))
    return scores.withColumn("rank", nth).filter(F.col("rank") <= k)


def with_dependencies(top: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task_id, file_path, nth): the top files, then their direct dependencies that aren't there yet, in order."""
    deps = top.join(edges.withColumnRenamed("src", "file_path").withColumnRenamed("pos", "edge_pos"), "file_path").join(nodes.select(F.col("file_path").alias("dst")).distinct(), "dst", "left_semi")
    own = top.select("task_id", "file_path", F.struct(F.lit(0).alias("step"), F.col("rank").alias("a"), F.lit(0).cast("long").alias("b")).alias("place"))
    more = deps.select("task_id", F.col("dst").alias("file_path"), F.struct(F.lit(1).alias("step"), F.col("rank").alias("a"), F.col("edge_pos").cast("long").alias("b")).alias("place"))
    all_of = own.unionByName(more).groupBy("task_id", "file_path").agg(F.min("place").alias("place"))
    return all_of.select("task_id", "file_path", F.row_number().over(W.partitionBy("task_id").orderBy("place", "file_path")).cast("long").alias("nth"))


def signatures(functions: Column, types: Column) -> Column:
    """Signature lines of a chunk's functions, then its types."""
    fn = lambda f: F.concat(F.when(f["is_async"], F.lit("async ")).otherwise(F.lit("")), F.lit("function "), f["name"], F.coalesce(f["params"], F.lit("")), F.coalesce(F.concat(F.lit(": "), f["return_type"]), F.lit("")))
    ty = lambda t: F.concat_ws(" ", t["kind"], t["name"], t["body"])
    return F.array_join(F.concat(F.transform(functions, fn), F.transform(types, ty)), "\n")


def chunk_candidates(chunks: DataFrame, active_path: str | None = None) -> DataFrame:
    """Candidates (task_id, pos, id, text, file_path, is_ast, score) of retrieved chunks; the file being edited is left out."""
    kept = chunks if not active_path else chunks.filter(~F.col("file_path").contains(active_path))
    text = F.concat(F.lit("// "), base_name("file_path"), F.lit(" (Signatures)\n"), signatures(F.col("functions"), F.col("types")))
    return kept.select("task_id", "pos", F.col("file_path").alias("id"), text.alias("text"), "file_path", F.lit(True).alias("is_ast"), F.lit(0.0).alias("score"))


def vector_candidates(hits: DataFrame) -> DataFrame:
    """Candidates of a vector search: (task_id, pos, file_path, content)."""
    return hits.select("task_id", "pos", F.concat(F.lit("rag_"), "file_path").alias("id"), F.col("content").alias("text"), "file_path", F.lit(False).alias("is_ast"), F.lit(0.0).alias("score"))


def candidate_union(first: DataFrame, second: DataFrame, each: int = 15) -> DataFrame:
    """The first ``each`` of either source per task, in order, without looking for files that both have; pos is numbered anew."""
    cut = lambda df, source: df.withColumn("r", F.row_number().over(W.partitionBy("task_id").orderBy("pos"))).filter(F.col("r") <= each).withColumn("source", F.lit(source))
    both = cut(first, 0).unionByName(cut(second, 1))
    return both.withColumn("pos", F.row_number().over(W.partitionBy("task_id").orderBy("source", "r")).cast("long")).drop("r", "source")


def words_of(text: str | Column) -> Column:
    """The words of a text: runs of ASCII letters, digits and underscores, in lower case. A null text has none."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)")), F.lower), F.array().cast("array<string>"))


@dataclass
class Corpus:
    """What a score needs of all texts. frequencies: word and the number of texts that have it; totals: one row, n texts and their words."""

    frequencies: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, texts: DataFrame, text_col: str = "text") -> Corpus:
        """Statistics of whole texts, one pass and written: words are counted before they are shuffled. Texts without words count as texts.

        Every text also has one null word, at which texts and their words are counted: so texts are read and cut once.
        """
        each = texts.select(words_of(text_col).alias("w"))
        told = each.select(F.size("w").alias("words"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("word"))
        counts = written(told.groupBy("word").agg(F.count("*").alias("frequency"), F.sum(F.when(F.col("word").isNull(), F.col("words"))).alias("words")), "frequencies")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return cls(counts.filter("word IS NOT NULL").select("word", "frequency"), counts.filter("word IS NULL").agg(total("frequency").alias("n"), total("words").alias("words")))


def bm25(candidates: DataFrame, tasks: DataFrame, corpus: Corpus, *, most: int = 512, k1: float = 1.2, b: float = 0.75, digits: int = 9) -> DataFrame:
    """(task_id, pos, score) of candidates (task_id, pos, text) for tasks (task_id, task): BM25 by the corpus' statistics.

    Task and text together are cut to ``most`` words, the longer one first, as a cross-encoder's input is. Each word of the task counts once; a word that the
    corpus lacks counts as rarest. No common word, a null text or a null task give 0, as does a corpus without words. Candidates are told
    by (task_id, pos): rows that repeat it are one candidate, with the greatest text.
    """
    half = most // 2
    cut = lambda own, other: F.slice(own, 1, F.least(F.size(own), F.greatest(F.lit(half), most - F.size(other))))
    asked = tasks.groupBy("task_id").agg(F.max("task").alias("task")).select("task_id", words_of("task").alias("q"))
    one = candidates.groupBy("task_id", "pos").agg(F.max("text").alias("text"))
    pairs = one.join(asked, "task_id", "left").select("task_id", "pos", F.coalesce("q", F.array().cast("array<string>")).alias("q"), words_of("text").alias("t"))
    pairs = pairs.select("task_id", "pos", F.array_distinct(cut("q", "t")).alias("q"), cut("t", "q").alias("t"))
    met = pairs.select("task_id", "pos", F.size("t").alias("length"), F.explode(F.filter("t", lambda x: F.array_contains("q", x))).alias("word"))
    times = met.groupBy("task_id", "pos", "word").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    n, mean = F.col("n"), F.col("words") / F.col("n")
    rare = F.log(1 + (n - F.col("frequency") + 0.5) / (F.col("frequency") + 0.5))
    part = rare * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    weighed = times.join(corpus.frequencies, "word", "left").fillna(0, "frequency").join(F.broadcast(corpus.totals)).filter("words > 0")  # one row is sent
    scores = weighed.groupBy("task_id", "pos").agg(F.round(F.sum(part), digits).alias("score"))
    return one.select("task_id", "pos").join(scores, ["task_id", "pos"], "left").fillna(0.0, "score")


def overlap(query: str, text: str) -> float:
    """Share of the query's words that a text has; the offline stand-in for a cross-encoder."""
    words = set(query.lower().split())
    return len(words & set(text.lower().split())) / len(words) if words else 0.0


def scorer(model: Callable[[str, str], float] = overlap, batch: int = 32):
    """A scoring function (query, text) as an iterator UDF: the model is loaded once per task and fed in batches."""

    ship(SparkSession.active())

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            out = []
            for lo in range(0, len(q), batch):
                out += [model(a or "", b or "") for a, b in zip(q[lo : lo + batch], t[lo : lo + batch], strict=True)]
            yield pd.Series(out, dtype="float64")

    return score


def hashed_embedding(text: str, size: int = 64) -> list[float]:
    """Signed word counts in ``size`` buckets, of unit length; the offline stand-in for an embedding model. No words: all zero."""
    import zlib

    out = [0.0] * size
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        out[h % size] += 1.0 if h >> 31 else -1.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def embedder(model: Callable[[str], Sequence[float]] = hashed_embedding, size: int = 64, most: int = 3000):
    """An embedding function as a vectorised UDF over the first ``most`` characters; a failing model gives zeros, which upserts skip."""

    ship(SparkSession.active())

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                return [float(x) for x in model((t or "")[:most])]
            except Exception:  # noqa: BLE001  a model's failure is data here
                return [0.0] * size

        for b in batches:
            yield b.map(one)

    return embed


def reranked(candidates: DataFrame, scores: DataFrame | None, top: int = 15) -> DataFrame:
    """The ``top`` candidates per task by score, ties in their order, numbered by rank; without scores the first ones with score 0."""
    if scores is None:
        scored = candidates.withColumn("score", F.lit(0.0))
    else:
        scored = candidates.drop("score").join(scores.select("task_id", "pos", "score"), ["task_id", "pos"])
    nth = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", nth.cast("long")).filter(F.col("rank") <= top)


def full_content(rows: DataFrame, sources: DataFrame, path: str = "file_path") -> DataFrame:
    """``rows`` with the content of their file, or a note that it isn't there or, where sources have a column ``error`` (``files.contents``), couldn't be read."""
    failed = F.concat(F.lit("// Error reading file: "), "error") if "error" in sources.columns else F.lit(None).cast("string")
    s = sources.select(F.col("path").alias(path), F.coalesce("content", failed).alias("full"))
    return rows.join(s, path, "left").withColumn("full", F.coalesce("full", F.concat(F.lit("// File not found: "), path)))


def tiered_chunks(ranked: DataFrame, full: int = 3, top: int = 15) -> DataFrame:
    """Budget chunks of ranked candidates with their file's content ``full``: the first three as whole files, the rest as their text.

    Tokens of whole files don't count the header line.
    """
    whole = F.col("rank") <= full
    head = F.concat(F.lit("// "), base_name("file_path"), F.lit(" (Full Context)\n"), F.col("full"))
    return ranked.filter(F.col("rank") <= top).select(
        "task_id",
        F.col("rank").alias("pos"),
        F.when(whole, F.concat(F.lit("high_fid_"), "id")).otherwise(F.col("id")).alias("id"),
        F.when(whole, head).otherwise(F.col("text")).alias("text"),
        F.when(whole, chunk_tokens("full")).otherwise(chunk_tokens("text")).alias("tokens"),
        F.when(whole, 100 + F.col("score") * 10).otherwise(F.col("score") * 10).alias("score"),
    )


def _suffixes(c: str) -> Column:
    """The proper suffixes of a text, from the second character on."""
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(2), F.length(c)), lambda i: F.substr(F.col(c), i))).otherwise(F.array().cast("array<string>"))


def active_chunk(active: DataFrame, files: DataFrame) -> DataFrame:
    """The budget chunk of the file being edited, (task_id, active_path) over files (pos, path, content): the first whose path ends with the other, either way.

    The join is one of keys. If the shorter path has a folder, the last parts of both are equal; if it is a bare name, it is a suffix of the
    other's last part, which is spelled out then. Empty and null paths match nothing; contents are looked up for what was found.
    """
    bare = lambda c: ~F.contains(c, F.lit("/"))
    keyed = lambda kind, each: F.transform(each, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    none = F.array().cast("array<struct<kind:int,key:string>>")

    def keys(df: DataFrame, path: str, own: int, other: int) -> DataFrame:
        named = df.filter(F.col(path) != "").withColumn("last", base_name(path))
        whole = F.when(bare(F.col(path)), keyed(own, F.array(path))).otherwise(none)
        return named.withColumn("k", F.explode(F.concat(keyed(0, F.array("last")), whole, keyed(other, _suffixes("last"))))).drop("last")

    a, f = keys(active.select("task_id", "active_path"), "active_path", 1, 2), keys(files.select("pos", "path"), "path", 2, 1)
    asked = a.select("k").distinct()
    hit = a.join(f.join(asked, "k", "left_semi"), "k").filter(F.endswith("path", F.col("active_path")) | F.endswith("active_path", F.col("path")))
    first = hit.groupBy("task_id", "active_path").agg(F.min(F.struct("pos", "path")).alias("f")).select("task_id", "active_path", "f.*").join(files.select("pos", "path", "content"), ["pos", "path"])
    return first.select("task_id", F.lit(0).cast("long").alias("pos"), F.lit("active_file_full").alias("id"), F.concat(F.lit("// ACTIVE FILE: "), "active_path", F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text"), chunk_tokens(F.coalesce("content", F.lit(""))).alias("tokens"), F.lit(2000.0).alias("score"))


def packed(chunks: DataFrame, budget: int, key: str = "task_id") -> DataFrame:
    """Chunks (key, pos, id, tokens, score) that a greedy packer takes: best first, ties in order; what doesn't fit is skipped and smaller ones still may.

    With a column ``tier`` the lower tiers are packed first and the others take what is left: tier 0 for chunks of the
    graph and 1 for those of a vector search. The fold is a native aggregate over one key's chunks; it carries the room
    left and the chosen places only. A key's chunks are the candidates of one request (some dozens): that is what the
    array holds.
    """
    tiers = ["tier"] if "tier" in chunks.columns else []
    item = F.struct(*tiers, (-F.col("score")).alias("s"), "pos", "id", "tokens")
    lists = chunks.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("room"), F.array().cast("array<long>").alias("taken"), F.lit(0).cast("long").alias("i"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["tokens"] <= acc["room"]
        return F.struct((acc["room"] - F.when(fits, x["tokens"]).otherwise(0)).cast("long").alias("room"), F.when(fits, F.concat(acc["taken"], F.array(acc["i"]))).otherwise(acc["taken"]).alias("taken"), (acc["i"] + 1).alias("i"))

    chosen = lists.select(key, "items", F.aggregate("items", start, step).alias("end"))
    picked = chosen.select(key, F.posexplode(F.transform(F.col("end.taken"), lambda i: F.get(F.col("items"), i.cast("int")))).alias("nth", "x"))
    return picked.select(key, F.col("nth").cast("long").alias("nth"), "x.pos", "x.id", "x.tokens", (-F.col("x.s")).alias("score"), *[F.col(f"x.{t}") for t in tiers])


def budget_contexts(taken: DataFrame, texts: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, ast_context, rag_context, ast_tokens, rag_tokens) of packed chunks with tiers: texts (key, id, text) joined by a blank line in the order taken."""
    rows = taken.join(texts, [key, "id"])
    text = lambda tier: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("tier") == tier, F.struct("nth", "text")))), lambda x: x["text"]), "\n\n")
    used = lambda tier: F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("tokens"))), F.lit(0)).cast("long")
    return rows.groupBy(key).agg(text(0).alias("ast_context"), text(1).alias("rag_context"), used(0).alias("ast_tokens"), used(1).alias("rag_tokens"))


def responses(contexts: DataFrame, chunks: DataFrame, threshold: float = 0.55, confidence: float = 0.85, key: str = "task_id") -> DataFrame:
    """(key, tokens, confidence, ast_section, rag_section, reasoning) of the contexts that ``budget_contexts`` makes and the chunks (key, cyclomatic) they were chosen from.

    The greatest cyclomatic number decides on thinking, 1 at least and for a request without chunks; then the first section begins with the
    mark that asks for it. A request without chunks of a vector search has no second section (null).
    """
    most = chunks.groupBy(key).agg(F.max("cyclomatic").alias("most"))
    think = thinks(F.greatest(F.col("most"), F.lit(1)), threshold)
    c = contexts.join(most, key, "left").withColumn("think", think)
    first = F.concat(F.when(F.col("think"), "/think\n\n").otherwise(""), F.lit("<ast_context>\n"), F.coalesce("ast_context", F.lit("")), F.lit("\n</ast_context>"))
    second = F.when(F.col("rag_context") != "", F.concat(F.lit("<rag_context>\n"), "rag_context", F.lit("\n</rag_context>")))
    return c.select(key, (F.col("ast_tokens") + F.col("rag_tokens")).alias("tokens"), F.lit(confidence).alias("confidence"), first.alias("ast_section"), second.alias("rag_section"), F.when(F.col("think"), "think").otherwise("no_think").alias("reasoning"))


def thinks(cyclomatic: Column, threshold: float = 0.55) -> Column:
    return F.coalesce(cyclomatic, F.lit(1)) >= threshold
