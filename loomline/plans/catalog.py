"""``QUERIES``: a function (spark, sf_dir) per operator. ``ORACLES``: the same in DuckDB's SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.ranking import numbered
from ..operators import extraction, graph, index, messages, retrieval, telemetry
from ..operators.nearest import nearest
from ..sources.scratch import written
from . import tables as t

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- index maintenance ---------------------------------------------------------------------------------------------


@query(f"WITH {t.MANIFEST_SQL} SELECT path, status FROM diff")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.manifest_diff(t.snapshot(spark, sf_dir), t.manifest(spark, sf_dir)).select("path", "status")


@query(f"""WITH {t.MANIFEST_SQL}, q AS (SELECT path, status, row_number() OVER (ORDER BY s_mtime DESC, path) AS rank FROM diff WHERE status IN ('NEW', 'CHANGED'))
SELECT path, status, rank, CASE WHEN rank <= 10 THEN 'HIGH' ELSE 'LOW' END AS priority, (rank - 1) // 6 AS batch FROM q""")
def index_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.startup_queue(index.manifest_diff(t.snapshot(spark, sf_dir), t.manifest(spark, sf_dir)))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/src/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "purchase", "HIGH").otherwise("LOW").alias("priority"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("queued_at"))


_JOBS_SQL = """jobs AS (SELECT '/src/' || user_id AS path, CASE WHEN event_type = 'purchase' THEN 'HIGH' ELSE 'LOW' END AS priority, event_id AS seq, epoch_us(ts) // 1000 AS queued_at FROM events),
queue AS (SELECT path, priority, seq, queued_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority = 'HIGH' DESC, seq DESC) AS r FROM jobs) WHERE r = 1)"""


@query(f"WITH {_JOBS_SQL} SELECT path, priority, seq, queued_at FROM queue")
def queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.queued(_jobs(spark, sf_dir))


@query(f"""WITH {_JOBS_SQL}, p AS (SELECT path, priority, queued_at, row_number() OVER (ORDER BY CASE WHEN priority = 'HIGH' THEN 0 ELSE 1 END, queued_at, path) AS place FROM queue)
SELECT path, priority, queued_at, place, (place - 1) // 6 AS batch FROM p""")
def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.batches(index.queued(_jobs(spark, sf_dir))).select("path", "priority", "queued_at", "place", "batch")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.read(spark, sf_dir, "embeddings").filter("vec_id % 5 = 0")
    return v.select((F.col("vec_id") + F.when(F.col("vec_id") % 15 == 0, 10_000_000).otherwise(0)).alias("vec_id"), F.when(F.col("vec_id") % 20 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.transform("embedding", lambda x: (x * 2).cast("float"))).alias("embedding"), F.lit("new").alias("source"))


@query("""WITH up AS (SELECT vec_id + CASE WHEN vec_id % 15 = 0 THEN 10000000 ELSE 0 END AS vec_id, list_transform(embedding, lambda x: x * 2) AS embedding FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 20 <> 0)
SELECT vec_id, source, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM (
SELECT vec_id, 'old' AS source, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM up) UNION ALL SELECT vec_id, 'new', embedding FROM up)""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = t.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit("old").alias("source"))
    out = index.upserted(base, _updates(spark, sf_dir), "vec_id", index.is_vector("embedding"))
    return out.select("vec_id", "source", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 17 <> 0")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return index.deleted(v, v.filter("vec_id % 17 = 0"), "vec_id")


@query(f"WITH {t.MANIFEST_SQL} SELECT path, size FROM manifest WHERE ast_version = 1 AND rag_version = 1 AND has_chunk")
def manifest_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.hydrated(t.manifest(spark, sf_dir)).select("path", "size")


# --- extraction and hashes -----------------------------------------------------------------------------------------

_BODIES = (("open", "{ a: { b: " + "x" * 300), ("shut", "{ a: string } " + "y" * 300), ("edge", "{" * 3 + "z" * 247), ("over", "{{}" + "z" * 240 + "     {tail"))


@query("WITH b AS (SELECT doc_id::VARCHAR AS id, text AS body FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _BODIES) + """) v(id, body)),
c AS (SELECT id, body, substr(body, 1, 250) AS cut FROM b), o AS (SELECT *, length(regexp_replace(cut, '[^{]', '', 'g')) - length(regexp_replace(cut, '[^}]', '', 'g')) AS n FROM c)
SELECT id, CASE WHEN length(body) <= 250 THEN body ELSE regexp_replace(cut, '\\s+$', '') || CASE WHEN n > 0 THEN ' /* … */ ' || repeat('}', n) ELSE ' /* … */' END END AS body FROM o""")
def truncate_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    return docs.unionByName(spark.createDataFrame(list(_BODIES), "id string, body string")).select("id", text.truncated_body("body").alias("body"))


@query("SELECT page_id, substr(sha256(url), 1, 8) AS project_id, sha1(html) AS file_hash, substr(sha256(html), 1, 10) AS short_hash FROM pages")
def project_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "pages").select("page_id", text.project_id("url").alias("project_id"), text.source_hash("html").alias("file_hash"), text.short_hash("html").alias("short_hash"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN split_part(url, '?', 1) = '' THEN '/' ELSE split_part(url, '?', 1) END AS path FROM pages UNION ALL SELECT * FROM (VALUES (-1, '/'), (-2, '?q=1'), (-3, '/a/b.js?x=/?')) v(page_id, url)),
q AS (SELECT page_id, CASE WHEN page_id < 0 THEN CASE WHEN split_part(path, '?', 1) = '' THEN '/' ELSE split_part(path, '?', 1) END ELSE path END AS path FROM p)
SELECT page_id, CASE WHEN path = '/' THEN 'index.html' ELSE regexp_replace(path, '^/', '') END AS file FROM q""")
def url_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.read(spark, sf_dir, "pages").select("page_id", "url")
    more = spark.createDataFrame([(-1, "/"), (-2, "?q=1"), (-3, "/a/b.js?x=/?")], "page_id long, url string")
    return own.unionByName(more).select("page_id", text.served_path("url").alias("file"))


#: Every document gives a source file, as no table holds code: its first words are the names, its number tells which declarations the file has.
def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("([A-Za-z]+)")).alias("w")).filter("size(w) >= 3")
    a, b, c = (F.get("w", F.lit(i)) for i in range(3))
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    head = line('import { x } from "./', a, '"\n\n')
    arrow = line("export const f_", b, " = async (n: number) => {\n  if (n < 1) return 0\n  return n\n}\n")
    plain = line("function f_", b, "(n: number) {\n  return n\n}\n")
    kind = line("export interface T_", c, " { size: number }\n")
    content = F.concat(head, F.when(F.col("doc_id") % 2 == 0, arrow).otherwise(plain), F.when(F.col("doc_id") % 3 == 0, kind).otherwise(F.lit("")))
    return d.select(t.path_of().alias("path"), content.alias("content"))


@query("""WITH w AS (SELECT doc_id, '/src/' || doc_id || '.ts' AS path, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
d AS (SELECT *, doc_id % 2 = 0 AS arrow, doc_id % 3 = 0 AS typed, CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 5 END AS ends FROM w WHERE len(w) >= 3)
SELECT path, 'import' AS kind, 0::BIGINT AS nth, './' || w[1] AS name, NULL::BIGINT AS first_line, NULL::BIGINT AS last_line FROM d
UNION ALL SELECT path, 'function', 0, 'f_' || w[2], 3, ends FROM d
UNION ALL SELECT path, 'type', 0, 'T_' || w[3], ends + 1, ends + 1 FROM d WHERE typed
UNION ALL SELECT path, 'export', 0, 'f_' || w[2], NULL, NULL FROM d WHERE arrow
UNION ALL SELECT path, 'export', CASE WHEN arrow THEN 1 ELSE 0 END, 'T_' || w[3], NULL, NULL FROM d WHERE typed
UNION ALL SELECT path, 'cyclomatic', 0, CASE WHEN arrow THEN '2' ELSE '1' END, NULL, NULL FROM d""")
def extract_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per declaration, import, export and complexity found in a source file of each document."""
    found = written(extraction.extracted(_code(spark, sf_dir)), "extracted")
    none = F.lit(None).cast("long")
    row = lambda kind, values, name, lo=none, hi=none: found.select("path", F.lit(kind).alias("kind"), F.posexplode(values).alias("nth", "x")).select("path", "kind", F.col("nth").cast("long").alias("nth"), name.cast("string").alias("name"), lo.cast("long").alias("first_line"), hi.cast("long").alias("last_line"))
    x, lines = F.col("x"), (F.col("x.start_line"), F.col("x.end_line"))
    parts = [row("function", "functions", x["name"], *lines), row("type", "types", x["name"], *lines), row("component", "components", x["name"]), row("import", "imports", x), row("export", "exports", x), row("cyclomatic", F.array("cyclomatic"), x)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {t.MANIFEST_SQL}, q AS (SELECT path, row_number() OVER (ORDER BY s_mtime DESC, path) AS rank FROM diff WHERE status IN ('NEW', 'CHANGED'))
SELECT d.path, d.status, coalesce(m.ast_version = 1 AND m.rag_version = 1 AND m.has_chunk, false) AND d.status <> 'DELETED' AS serves, CASE WHEN q.rank <= 10 THEN 'HIGH' WHEN q.rank IS NOT NULL THEN 'LOW' END AS priority
FROM diff d LEFT JOIN manifest m ON m.path = d.path LEFT JOIN q ON q.path = d.path""")
def startup_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, manifest = t.snapshot(spark, sf_dir), t.manifest(spark, sf_dir)
    s = index.reconciled(snapshot, manifest)
    every = index.manifest_diff(snapshot, manifest).select("path", "status")
    serves = s.nodes.select("path", F.lit(True).alias("serves"))
    return every.join(serves, "path", "left").join(s.queue.select("path", "priority"), "path", "left").select("path", "status", F.coalesce("serves", F.lit(False)).alias("serves"), "priority")


@query("""WITH jobs AS (SELECT doc_id, '/src/' || doc_id || '.ts' AS path, doc_id % 15 = 0 AS dead FROM documents WHERE doc_id % 5 = 0),
old AS (SELECT '/src/' || doc_id || '.ts' AS path, 'old' AS hash, 1 AS version FROM documents WHERE doc_id % 3 <> 1),
new AS (SELECT path, sha1(text) AS hash, 2 AS version, n_chars % 2 AS v FROM jobs JOIN documents USING (doc_id) WHERE NOT dead AND doc_id % 20 <> 5),
m AS (SELECT * FROM old WHERE path NOT IN (SELECT path FROM jobs) UNION ALL SELECT path, hash, version FROM new),
v AS (SELECT path FROM old WHERE path NOT IN (SELECT path FROM jobs) UNION ALL SELECT path FROM new WHERE v = 1 OR path IN (SELECT path FROM old))
SELECT m.path, m.hash, m.version, v.path IS NOT NULL AS embedded FROM m LEFT JOIN v ON v.path = m.path""")
def index_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a fifth has jobs, of which some are deletions, some have no source and some no vector."""
    d = t.read(spark, sf_dir, "documents").withColumn("path", t.path_of())
    jobs = d.filter("doc_id % 5 = 0").select("path", F.when(F.col("doc_id") % 15 == 0, "DELETED").otherwise("CHANGED").alias("reason"))
    vector = lambda x: F.array(x.cast("float"))
    old = d.filter("doc_id % 3 != 1").select("path", F.lit("old").alias("hash"), F.lit(1).alias("version"), vector(F.lit(1)).alias("vector"))
    new = d.filter("doc_id % 20 != 5").select("path", text.source_hash("text").alias("hash"), F.lit(2).alias("version"), vector(F.col("n_chars") % 2).alias("vector"))
    out = index.indexed(jobs, old.select("path", "hash", "version"), old.select("path", "version"), old.select("path", "vector"), new)
    rows = out.manifest.hint("merge").join(out.nodes.select("path"), "path", "left_semi")
    return rows.hint("merge").join(out.vectors.select("path", F.lit(True).alias("e")), "path", "left").select("path", "hash", "version", F.coalesce("e", F.lit(False)).alias("embedded"))


# --- retrieval -----------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 20""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = t.read(spark, sf_dir, "embeddings")
    first = vectors.filter("vec_id = 0").select("embedding").head(1)
    return retrieval.knn(vectors, first[0]["embedding"] if first else [], 20)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to every vector whose id is divisible by 20, exactly."""
    vectors = t.read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 10)


_TASKS_SQL = "tasks AS (SELECT item_id AS task_id, lower(text) AS task FROM benchmark)"
#: Symbols of a document: all its words, the third one a type, and its file name.
_SYMBOLS_SQL = """words AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
symbols AS (SELECT doc_id AS pos, '/src/' || doc_id || '.ts' AS file_path, CASE WHEN i = 3 THEN 'type' ELSE 'function' END AS kind, name FROM (SELECT doc_id, unnest(w) AS name, generate_subscripts(w, 1) AS i FROM words)
  UNION ALL SELECT doc_id, '/src/' || doc_id || '.ts', 'file', doc_id::VARCHAR FROM words),
scores AS (SELECT task_id, file_path, min(pos) AS pos, sum(CASE kind WHEN 'function' THEN 3 ELSE 2 END)::BIGINT AS score FROM symbols JOIN tasks ON contains(task, lower(name))
  WHERE length(name) >= 2 AND lower(name) NOT IN (""" + ", ".join(f"'{g}'" for g in retrieval.GENERIC) + ") GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY task_id, file_path")
_TOP_SQL = f"{_TASKS_SQL}, {_SYMBOLS_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, pos, file_path) AS rank FROM scores) WHERE rank <= 5)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents").withColumn("pos", F.col("doc_id")).withColumn("file_path", t.path_of())
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))
    named = docs.select("pos", "file_path", F.posexplode(words).alias("i", "name")).select("pos", "file_path", F.when(F.col("i") == 2, "type").otherwise("function").alias("kind"), "name")
    return retrieval.task_scores(_tasks(spark, sf_dir), named.unionByName(retrieval.file_symbols(docs)))


@query(f"WITH {_TOP_SQL} SELECT task_id, file_path, score FROM scores")
def task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("task_id", "file_path", "score")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best files per task, over an index of the documents' words."""
    docs = t.read(spark, sf_dir, "documents").withColumn("file_path", t.path_of())
    rows = docs.select(F.col("doc_id").alias("pos"), "file_path", F.coalesce(F.regexp_extract_all("text", F.lit("([A-Za-z]+)")), F.array().cast("array<string>")).alias("w"))
    kinds = [("function", F.concat(F.slice("w", 1, 2), F.slice("w", 4, F.greatest(F.size("w"), F.lit(1))))), ("type", F.slice("w", 3, 1)), ("file", F.array(text.stem("file_path")))]
    rows = rows.select("pos", "file_path", F.array(*[F.struct(F.lit(kind).alias("kind"), names.alias("names")) for kind, names in kinds]).alias("symbols"))
    return retrieval.top_scored(_tasks(spark, sf_dir), retrieval.symbol_index(rows))


@query(f"WITH {_TOP_SQL} SELECT task_id, file_path, score, rank FROM top")
def task_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("task_id", "file_path", "score", F.col("rank").cast("long").alias("rank"))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = t.dag(spark, sf_dir)
    name = lambda c: F.concat(F.lit("/src/"), F.col(c).cast("string"), F.lit(".ts"))
    return retrieval.with_dependencies(_top(spark, sf_dir), edges.select(name("src").alias("src"), "pos", name("dst").alias("dst")), nodes.select(name("node").alias("file_path")))


_EXPAND_SQL = f"""WITH {_TOP_SQL}, {t.DAG_SQL}, named AS (SELECT '/src/' || src || '.ts' AS src, pos, '/src/' || dst || '.ts' AS dst FROM edges),
every AS (SELECT task_id, file_path, 0 AS step, rank AS a, 0 AS b FROM top UNION ALL SELECT task_id, dst, 1, rank, n.pos FROM top JOIN named n ON n.src = file_path),
best AS (SELECT task_id, file_path, min((step, a, b)) AS place FROM every GROUP BY task_id, file_path),
expanded AS (SELECT task_id, file_path, row_number() OVER (PARTITION BY task_id ORDER BY place, file_path) AS nth FROM best)"""


@query(f"{_EXPAND_SQL} SELECT task_id, file_path, nth FROM expanded")
def task_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir)


@query(f"""{_EXPAND_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
hits AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6), vec_id) AS nth FROM embeddings, q),
both_of AS (SELECT task_id, 0 AS source, nth, file_path AS id FROM expanded WHERE nth <= 15 UNION ALL SELECT task_id, 1, nth, 'rag_/vec/' || vec_id FROM (SELECT DISTINCT task_id FROM expanded), hits WHERE nth <= 15)
SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY source, nth) AS pos, id FROM both_of""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _expanded(spark, sf_dir).withColumn("pos", F.col("nth"))
    ast = chunks.select("task_id", "pos", F.col("file_path").alias("id"))
    hits = knn_topk(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("h"))  # 20 rows
    per_task = ast.select("task_id").distinct().join(F.broadcast(hits)).select("task_id", F.posexplode("h").alias("p", "x"))
    rag = per_task.select("task_id", (F.col("p") + 1).cast("long").alias("pos"), F.concat(F.lit("rag_/vec/"), F.col("x.vec_id").cast("string")).alias("id"))
    return retrieval.candidate_union(ast, rag).select("task_id", "pos", "id")


@query(f"WITH {t.CANDIDATES_SQL} SELECT task_id, id, rank, 0.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS rank FROM candidates) WHERE rank <= 15")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(t.candidates(spark, sf_dir), None).select("task_id", "id", "rank", "score")


_RANKED_SQL = f"{t.CANDIDATES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, pos) AS rank FROM candidates)"


@query(f"""WITH {_RANKED_SQL} SELECT task_id, rank AS pos, CASE WHEN rank <= 3 THEN 'high_fid_' || id ELSE id END AS id, greatest(1, length(text) // 4) AS tokens,
CASE WHEN rank <= 3 THEN 100 + score * 10 ELSE score * 10 END AS score, length(CASE WHEN rank <= 3 THEN '// ' || id || '.ts (Full Context)' || chr(10) || text ELSE text END) AS n FROM ranked WHERE rank <= 15""")
def tiered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.candidates(spark, sf_dir)
    ranked = retrieval.reranked(c, c.select("task_id", "pos", "score"))
    files = t.read(spark, sf_dir, "documents").select(t.path_of().alias("path"), F.col("text").alias("content"))
    out = retrieval.tiered_chunks(retrieval.full_content(ranked, files))
    return out.select("task_id", "pos", "id", "tokens", "score", F.length("text").cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_RANKED_SQL}, c AS (SELECT task_id, rank AS i, id, greatest(1, length(text) // 4) AS tokens FROM ranked WHERE rank <= 15),
fold(task_id, i, room, taken, id, tokens) AS (SELECT DISTINCT task_id, 0::BIGINT, 4096::BIGINT, false, '', 0::BIGINT FROM c
  UNION ALL SELECT f.task_id, c.i, CASE WHEN c.tokens <= f.room THEN f.room - c.tokens ELSE f.room END, c.tokens <= f.room, c.id, c.tokens FROM fold f JOIN c ON c.task_id = f.task_id AND c.i = f.i + 1)
SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY i) - 1 AS nth, id, tokens FROM fold WHERE taken""")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.candidates(spark, sf_dir)
    ranked = retrieval.reranked(c, c.select("task_id", "pos", "score")).withColumn("tokens", text.chunk_tokens("text"))
    return retrieval.packed(ranked.select("task_id", "pos", "id", "tokens", "score"), 4096).select("task_id", "nth", "id", "tokens")


@query(f"""WITH RECURSIVE {_RANKED_SQL}, d AS (SELECT task_id, pos, id, pos % 2 AS tier, score, greatest(1, length(text) // 4) AS tokens FROM ranked WHERE rank <= 30),
c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY tier, score DESC, pos) AS i FROM d),
fold(task_id, i, room, taken, id, tier, tokens) AS (SELECT DISTINCT task_id, 0::BIGINT, 4096::BIGINT, false, '', 0::BIGINT, 0::BIGINT FROM c
  UNION ALL SELECT f.task_id, c.i, CASE WHEN c.tokens <= f.room THEN f.room - c.tokens ELSE f.room END, c.tokens <= f.room, c.id, c.tier, c.tokens FROM fold f JOIN c ON c.task_id = f.task_id AND c.i = f.i + 1)
SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY i) - 1 AS nth, id, tier, tokens FROM fold WHERE taken""")
def budget_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.candidates(spark, sf_dir)
    ranked = retrieval.reranked(c, c.select("task_id", "pos", "score"), 30).withColumn("tokens", text.chunk_tokens("text"))
    return retrieval.packed(ranked.select("task_id", "pos", "id", "tokens", "score", (F.col("pos") % 2).alias("tier")), 4096).select("task_id", "nth", "id", "tier", "tokens")


_TAKEN_SQL = """fold(task_id, i, room, taken, id, tier, tokens) AS (SELECT DISTINCT task_id, 0::BIGINT, 4096::BIGINT, false, '', 0::BIGINT, 0::BIGINT FROM c
  UNION ALL SELECT f.task_id, c.i, CASE WHEN c.tokens <= f.room THEN f.room - c.tokens ELSE f.room END, c.tokens <= f.room, c.id, c.tier, c.tokens FROM fold f JOIN c ON c.task_id = f.task_id AND c.i = f.i + 1)"""


@query(f"""WITH RECURSIVE {_RANKED_SQL}, d AS (SELECT task_id, pos, id, CASE WHEN task_id = 1 THEN 0 ELSE pos % 2 END AS tier, score, greatest(1, length(text) // 4) AS tokens FROM ranked WHERE rank <= 30),
c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY tier, score DESC, pos) AS i FROM d), {_TAKEN_SQL},
j AS (SELECT f.task_id, sum(f.tokens)::BIGINT AS tokens, coalesce(string_agg(r.text, chr(10) || chr(10) ORDER BY f.i) FILTER (WHERE tier = 0), '') AS a, string_agg(r.text, chr(10) || chr(10) ORDER BY f.i) FILTER (WHERE tier = 1) AS v
  FROM fold f JOIN ranked r ON r.task_id = f.task_id AND r.id = f.id WHERE taken GROUP BY f.task_id),
m AS (SELECT task_id, greatest(1, max(CASE WHEN pos % 3 > 0 THEN pos % 6 END)) > 4 AS think FROM ranked WHERE rank <= 30 GROUP BY task_id)
SELECT task_id, tokens, 0.85::DOUBLE AS confidence, md5(CASE WHEN think THEN '/think' || chr(10) || chr(10) ELSE '' END || '<ast_context>' || chr(10) || a || chr(10) || '</ast_context>') AS ast_md5,
md5('<rag_context>' || chr(10) || v || chr(10) || '</rag_context>') AS rag_md5, CASE WHEN think THEN 'think' ELSE 'no_think' END AS reasoning FROM j JOIN m USING (task_id)""")
def context_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests are answered with: chunks of two tiers packed, their texts in sections, thinking by the most tangled chunk."""
    c = t.candidates(spark, sf_dir)
    ranked = retrieval.reranked(c, c.select("task_id", "pos", "score"), 30).withColumn("tokens", text.chunk_tokens("text"))
    ranked = ranked.withColumn("tier", F.when(F.col("task_id") == 1, 0).otherwise(F.col("pos") % 2)).withColumn("cyclomatic", F.when(F.col("pos") % 3 > 0, F.col("pos") % 6))
    taken = retrieval.packed(ranked.select("task_id", "pos", "id", "tokens", "score", "tier"), 4096)
    out = retrieval.responses(retrieval.budget_contexts(taken, ranked.select("task_id", "id", "text")), ranked, threshold=4.5)
    md5 = lambda x: F.md5(F.col(x).cast("binary"))
    return out.select("task_id", "tokens", "confidence", md5("ast_section").alias("ast_md5"), md5("rag_section").alias("rag_md5"), "reasoning")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)
SELECT doc_id % 7 AS task_id, doc_id AS pos, '/src/' || doc_id || '.ts' AS id, '// ' || doc_id || '.ts (Signatures)' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'async ' ELSE '' END || 'function ' || coalesce(w[1], '') || '(' || coalesce(w[2], '') || ')'
|| CASE WHEN doc_id % 4 = 0 THEN '' ELSE ': ' || coalesce(w[3], '') END || chr(10) || 'type ' || coalesce(w[4], '') || ' ' || coalesce(w[5], '') AS text, true AS is_ast, 0.0::DOUBLE AS score FROM w WHERE NOT contains('/src/' || doc_id || '.ts', '/src/1')""")
def signature_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk of one function and one type, named by its words; the file being edited is left out."""
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    d = t.read(spark, sf_dir, "documents").select("doc_id", t.path_of().alias("file_path"), F.regexp_extract_all("text", F.lit("([A-Za-z]+)")).alias("w"))
    function = F.struct(w(0).alias("name"), F.concat(F.lit("("), w(1), F.lit(")")).alias("params"), F.when(F.col("doc_id") % 4 != 0, w(2)).alias("return_type"), (F.col("doc_id") % 3 == 0).alias("is_async"))
    types = F.struct(F.lit("type").alias("kind"), w(3).alias("name"), w(4).alias("body"))
    chunks = d.select((F.col("doc_id") % 7).alias("task_id"), F.col("doc_id").alias("pos"), "file_path", F.array(function).alias("functions"), F.array(types).alias("types"))
    return retrieval.chunk_candidates(chunks, "/src/1").drop("file_path")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS task_id, v AS q FROM v WHERE vec_id % 50 = 0),
d AS (SELECT task_id, vec_id, label, round(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY distance, vec_id) AS pos FROM d)
SELECT task_id, pos, 'rag_/vec/' || vec_id AS id, label::VARCHAR AS text, false AS is_ast, 0.0::DOUBLE AS score FROM r WHERE pos <= 20""")
def rag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to each task's as candidates; distances are dropped, contents looked up for what was found."""
    vectors = t.read(spark, sf_dir, "embeddings")
    best = nearest(vectors, vectors.filter("vec_id % 50 = 0"), 20)
    found = best.select(F.col("query_id").alias("task_id"), F.col("rank").cast("long").alias("pos"), F.col("id").alias("vec_id")).join(vectors.select("vec_id", F.col("label").cast("string").alias("content")), "vec_id")
    return retrieval.vector_candidates(found.withColumn("file_path", F.concat(F.lit("/vec/"), F.col("vec_id").cast("string")))).drop("file_path")


_ACTIVE = ("src/{}.ts", "/home/me/src/{}.ts", "{}.ts", "/src/{}.ts", "c/{}.ts", "x{}.ts")


@query("""WITH a AS (SELECT item_id AS task_id, replace((["""
    + ", ".join(f"'{x}'" for x in _ACTIVE)
    + """])[(row_number() OVER (ORDER BY item_id) % 6)::BIGINT + 1], '{}', (row_number() OVER (ORDER BY item_id) * 7)::VARCHAR) AS p FROM (SELECT DISTINCT item_id FROM benchmark)),
f AS (SELECT doc_id AS pos, '/src/' || doc_id || '.ts' AS path, text FROM documents), h AS (SELECT task_id, p, min(pos) AS pos FROM a, f WHERE suffix(path, p) OR suffix(p, path) GROUP BY task_id, p)
SELECT task_id, 'active_file_full' AS id, md5('// ACTIVE FILE: ' || p || chr(10) || text) AS text_md5, greatest(1, length(text) // 4) AS tokens, 2000.0::DOUBLE AS score FROM h JOIN f USING (pos)""")
def active_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file being edited of each benchmark item: paths with other roots, of some folders, bare names and parts of names."""
    nth = numbered(t.read(spark, sf_dir, "benchmark").select("item_id").distinct(), F.col("item_id"))
    path = F.get(F.array(*[F.lit(x) for x in _ACTIVE]), (F.col("nth") % 6).cast("int"))
    active = nth.select(F.col("item_id").alias("task_id"), F.replace(path, F.lit("{}"), (F.col("nth") * 7).cast("string")).alias("active_path"))
    files = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), t.path_of().alias("path"), F.col("text").alias("content"))
    return retrieval.active_chunk(active, files).select("task_id", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "tokens", "score")


@query("""SELECT CASE WHEN m > 0 THEN round(greatest(0.1, m - 0.1), 6) ELSE 0.55 END AS threshold FROM (
SELECT avg(value / 1000) FILTER (WHERE event_id % 3 = 0 AND event_type = 'error') AS m FROM events)""")
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    rows = e.select((F.col("value") / 1000).alias("score"), F.when(F.col("event_id") % 3 == 0, "no_think").otherwise("think").alias("reasoning"), (F.col("event_type") != "error").cast("int").alias("success"))
    return telemetry.calibrated_threshold(rows).select(F.round("threshold", 6).alias("threshold"))


@query(f"""{_EXPAND_SQL}, c AS (SELECT e.task_id, e.nth AS pos, e.file_path AS id,
    list_filter(list_distinct(string_split_regex(t.task, '[\\s\\x0b\\x1c-\\x1f]+')), lambda w: w <> '') AS asked, string_split_regex(lower(d.text), '[\\s\\x0b\\x1c-\\x1f]+') AS words
  FROM expanded e JOIN tasks t ON t.task_id = e.task_id JOIN documents d ON e.file_path = '/src/' || d.doc_id || '.ts'),
s AS (SELECT task_id, pos, id, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, words)) / len(asked)::DOUBLE ELSE 0.0 END AS score FROM c),
r AS (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, pos) AS rank, round(score, 6) AS score FROM s)
SELECT task_id, id, rank, score FROM r WHERE rank <= 15""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    pairs = retrieval.with_dependencies(_top(spark, sf_dir), *_dag_paths(spark, sf_dir)).join(tasks, "task_id")
    docs = t.read(spark, sf_dir, "documents").select(t.path_of().alias("file_path"), "text")
    c = pairs.join(docs, "file_path").select("task_id", F.col("nth").alias("pos"), F.col("file_path").alias("id"), "text", "task")
    scored = c.select("task_id", "pos", retrieval.scorer()("task", "text").alias("score"))
    return retrieval.reranked(c, scored).select("task_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""{_EXPAND_SQL}, texts AS (SELECT '/src/' || doc_id || '.ts' AS file_path, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents),
totals AS (SELECT count(*) AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM texts),
df AS (SELECT word, count(*) AS f FROM (SELECT unnest(list_distinct(w)) AS word FROM texts) GROUP BY word),
p AS (SELECT e.task_id, e.nth AS pos, e.file_path AS id, list_transform(regexp_extract_all(t.task, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS q, w.w AS t FROM expanded e JOIN tasks t ON t.task_id = e.task_id JOIN texts w ON w.file_path = e.file_path),
c AS (SELECT task_id, pos, id, list_distinct(q[1:greatest(256, 512 - len(t))]) AS q, t[1:greatest(256, 512 - len(q))] AS t FROM p),
m AS (SELECT task_id, pos, len(t) AS length, q, unnest(t) AS word FROM c),
tf AS (SELECT task_id, pos, word, length, count(*) AS tf FROM m WHERE list_contains(q, word) GROUP BY task_id, pos, word, length),
s AS (SELECT task_id, pos, round(sum(ln(1 + (n - coalesce(f, 0) + 0.5) / (coalesce(f, 0) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM tf CROSS JOIN totals LEFT JOIN df USING (word) GROUP BY task_id, pos),
r AS (SELECT task_id, id, coalesce(score, 0) AS s, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(score, 0) DESC, pos) AS rank FROM c LEFT JOIN s USING (task_id, pos))
SELECT task_id, id, rank, round(s, 6) AS score FROM r WHERE rank <= 15""")
def rerank_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that tasks name, and what these depend on, ranked by BM25 over all documents."""
    tasks = _tasks(spark, sf_dir)
    docs = t.read(spark, sf_dir, "documents").select(t.path_of().alias("file_path"), "text")
    c = _expanded(spark, sf_dir).join(docs, "file_path").select("task_id", F.col("nth").alias("pos"), F.col("file_path").alias("id"), "text")
    c = written(c, "candidates")  # some files a task; they are found and read once, not for each use
    scores = retrieval.bm25(c, tasks, retrieval.Corpus.of(docs))
    return retrieval.reranked(c, scores).select("task_id", "id", "rank", F.round("score", 6).alias("score"))


def _dag_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = t.dag(spark, sf_dir)
    name = lambda c: F.concat(F.lit("/src/"), F.col(c).cast("string"), F.lit(".ts"))
    return edges.select(name("src").alias("src"), "pos", name("dst").alias("dst")), nodes.select(name("node").alias("file_path"))


@query()
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents")
    return docs.select("doc_id", retrieval.embedder()("text").alias("vector")).filter(index.is_vector("vector"))


# --- messages ------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT -doc_id - 10, 0, 'user', text FROM documents),
c AS (SELECT DISTINCT conv_id FROM m) SELECT c.conv_id, coalesce(u.task, '') AS task FROM c LEFT JOIN (SELECT conv_id, arg_max(substr(content, 1, 500), turn) AS task FROM m WHERE role = 'user' GROUP BY conv_id) u ON c.conv_id = u.conv_id""")
def task_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    more = t.read(spark, sf_dir, "documents").select((-F.col("doc_id") - 10).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("text").alias("content"))
    return messages.task_text(own.unionByName(more))


@query("SELECT conv_id, turn, ceil(length(text) / 4)::BIGINT AS block_tokens, length(role || chr(10) || text || chr(10)) // 4 AS message_tokens, greatest(1, length(text) // 4) AS chunk_tokens FROM conversations")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.block_tokens("text").alias("block_tokens"), text.fallback_tokens(text.message_text("role", "text")).alias("message_tokens"), text.chunk_tokens("text").alias("chunk_tokens"))


def _any_sql(words, c="low"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_USEFUL_SQL = "list_filter(string_split(content, chr(10)), lambda l: " + _any_sql(text.USEFUL, "lower(l)") + ")"
_FILE_SQL = (r"""nullif(regexp_extract(content, '<file_content[^>]*path=["'']?([^"''\s>]+)', 1, 'i'), '')""", r"nullif(regexp_extract(content, '# ([^\n]+\.(ts|tsx|js|jsx|py|rs|go|md))', 1, 'i'), '')")
_CLASSIFIED_SQL = f"""{t.MESSAGES_SQL},
numbered AS (SELECT *, lower(content) AS low, ceil(length(content) / 4)::BIGINT AS est, CASE WHEN role = 'system' THEN count(*) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS system_index FROM messages),
kinds AS (SELECT *, CASE WHEN role <> 'system' THEN NULL WHEN system_index = 0 THEN 'persona' WHEN {_any_sql(rules.DIAGNOSTICS)} THEN 'diagnostics' WHEN {_any_sql(rules.TERMINAL)} THEN 'terminal'
  WHEN {_any_sql(rules.TREE)} OR len(regexp_extract_all(content, '{rules.BOX}')) > 10 THEN 'workspace_tree' WHEN {_any_sql(rules.ENVIRONMENT)} THEN 'environment'
  WHEN coalesce({_FILE_SQL[0]}, {_FILE_SQL[1]}) IS NOT NULL OR {_any_sql(rules.FILE)} THEN CASE WHEN est < 4000 THEN 'active_file' ELSE 'other_file' END ELSE 'unknown' END AS kind,
  CASE WHEN len({_USEFUL_SQL}) > 0 THEN '<environment>' || chr(10) || array_to_string({_USEFUL_SQL}[1:20], chr(10)) || chr(10) || '</environment>' END AS small FROM numbered),
classified AS (SELECT *, CASE WHEN kind IS NULL OR kind IN ('persona', 'diagnostics') THEN true WHEN kind = 'terminal' THEN est < 600 WHEN kind = 'environment' THEN small IS NOT NULL WHEN kind = 'unknown' THEN est < 2000 ELSE false END AS kept FROM kinds),
finals AS (SELECT *, CASE WHEN kept THEN CASE WHEN kind = 'environment' THEN small ELSE content END END AS final FROM classified)"""


@query(f"WITH {_CLASSIFIED_SQL} SELECT conv_id, turn, system_index, kind, kept, final FROM finals")
def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.classified(t.messages(spark, sf_dir)).select("conv_id", "turn", "system_index", "kind", "kept", "final")


_KINDS = ("persona", "diagnostics", "terminal", "workspace_tree", "environment", "active_file", "other_file", "unknown")


@query(f"""WITH {_CLASSIFIED_SQL}, f AS (SELECT *, CASE WHEN role = 'system' THEN coalesce(nullif(regexp_extract(content, 'active file:? ([^\\s]+)', 1, 'i'), ''), {_FILE_SQL[0]}) END AS p,
CASE WHEN role = 'system' THEN coalesce(nullif(regexp_extract(content, 'cursor position:? line (\\d+)', 1, 'i'), ''), nullif(regexp_extract(content, 'line (\\d+), column', 1, 'i'), ''))::INT END AS l FROM finals)
SELECT conv_id, sum(est)::BIGINT AS tokens_raw, coalesce(sum(ceil(length(final) / 4)::BIGINT) FILTER (WHERE kept), 0)::BIGINT AS tokens_engineered, count(*) FILTER (WHERE NOT kept) AS blocks_dropped,
{", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _KINDS)}, arg_max(p, turn) FILTER (WHERE p IS NOT NULL) AS active_path, arg_max(l, turn) FILTER (WHERE l IS NOT NULL) AS cursor_line FROM f GROUP BY conv_id""")
def engineer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.engineered(t.messages(spark, sf_dir))


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'system') AS spot FROM conversations GROUP BY conv_id),
rows AS (SELECT conv_id, turn AS a, 0 AS b, role, text AS content FROM conversations UNION ALL SELECT conv_id, coalesce(spot, -1), 1, 'system', '/think' || chr(10) || '<context>' || chr(10) || 'files of ' || conv_id || chr(10) || '</context>' FROM f WHERE conv_id % 3 <> 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY a, b) - 1 AS turn, role, content FROM rows""")
def inject_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    ast = F.when(F.col("conv_id") % 3 != 1, F.concat(F.lit("files of "), F.col("conv_id").cast("string")))
    ctx = c.select("conv_id").distinct().select("conv_id", messages.context_message(F.col("conv_id") % 3 != 1, ast, F.lit(None).cast("string")).alias("context"))
    return messages.injected(c, ctx)


@query("""WITH m AS (SELECT conv_id, turn, length(role || chr(10) || text || chr(10)) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + max(CASE WHEN nth = 1 THEN tokens END) OVER (PARTITION BY conv_id) AS rest FROM m)
SELECT conv_id, turn, tokens FROM s WHERE nth = 1 OR nth = n OR rest <= 300""")
def trim_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return messages.trimmed(c, 300).select("conv_id", "turn", "tokens")


@query("""WITH d AS (SELECT doc_id, replace(text, ' ', chr(10)) AS content, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 7) % 260 END AS spot FROM documents),
l AS (SELECT doc_id, content, spot, string_split(content, chr(10)) AS x FROM d), k AS (SELECT *, len(x) AS n, greatest(0, spot - 60) AS a, least(len(x), spot + 60) AS b FROM l)
SELECT doc_id, md5(CASE WHEN n <= 150 THEN content WHEN spot > 0 THEN '// ... (' || a || ' lines omitted)' || chr(10) || CASE WHEN b > a THEN array_to_string(x[a + 1:b], chr(10)) || chr(10) ELSE '' END || '// ... (' || (n - b) || ' lines omitted)'
ELSE array_to_string(x[1:80], chr(10)) || chr(10) || '// ... (' || (n - 130) || ' lines omitted)' || chr(10) || array_to_string(x[n - 49:n], chr(10)) END) AS digest FROM k""")
def compact_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.read(spark, sf_dir, "documents")
    content = F.replace("text", F.lit(" "), F.lit("\n"))  # a line for each word
    at = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") * 7 % 260).cast("int")
    rows = d.select("doc_id", content.alias("content"), at.alias("at"))
    return rows.select("doc_id", F.md5(text.compacted_file("content", "at").cast("binary")).alias("digest"))


_TOOLS = ("read_file", "Write_File", "list_dir", "web_search", "browser_open", "fetch", "httpGet", "grep", "run_tests", "profile")


@query("WITH tools AS (SELECT conv_id, pos, name FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_TOOLS)) + r""") v(pos, name) WHERE (conv_id + pos) % 3 <> 0),
task AS (SELECT conv_id, arg_max(substr(text, 1, 500), turn) || CASE WHEN conv_id % 5 = 0 THEN ' please Open it' WHEN conv_id % 5 = 1 THEN ' reopen profiles' ELSE '' END AS task FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT tools.conv_id, pos, name FROM tools LEFT JOIN task ON tools.conv_id = task.conv_id WHERE regexp_matches(coalesce(task, ''), '(?i)\b(create|write|file|search|fetch|open)\b') OR NOT regexp_matches(name, '(?i)^(read_file|write_file|list_dir|web_search|browser|fetch|http)')""")
def shape_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    listed = F.posexplode(F.array(*[F.lit(n) for n in _TOOLS])).alias("pos", "name")
    tools = c.select("conv_id").distinct().select("conv_id", listed).filter((F.col("conv_id") + F.col("pos")) % 3 != 0)
    tail = F.when(F.col("conv_id") % 5 == 0, " please Open it").when(F.col("conv_id") % 5 == 1, " reopen profiles").otherwise("")
    tasks = messages.task_text(c.filter("role = 'user'")).select("conv_id", F.concat("task", tail).alias("task"))
    return messages.shaped_tools(tools, tasks)


@query("""WITH m AS (SELECT conv_id, to_json(list(json_object('role', role, 'content', text) ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('{"model":"m' || conv_id % 3 || '","messages":' || messages || ',"stream":' || (conv_id % 2 = 0) || ',"keep_alive":-1' || CASE WHEN conv_id % 4 = 0 THEN ',"tools":["read"]}' ELSE '}' END) AS payload_md5 FROM m""")
def final_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    bodies = c.select("conv_id").distinct().select("conv_id", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), (F.col("conv_id") % 2 == 0).alias("stream"))
    tools = bodies.filter("conv_id % 4 = 0").select("conv_id", F.lit(0).alias("pos"), F.lit("read").alias("name"))
    return messages.payloads(bodies, c, tools).select("conv_id", F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


# --- telemetry -----------------------------------------------------------------------------------------------------

_STATS_SQL = f"""WITH {t.REQUESTS_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, sum(latency_ms)::BIGINT AS latency_ms, sum(tokens_before)::BIGINT AS tokens_before,
sum(tokens_after)::BIGINT AS tokens_after, sum(greatest(0, tokens_raw - tokens_after))::BIGINT AS tokens_removed, sum(greatest(0, tokens_after - tokens_before))::BIGINT AS tokens_injected, sum(greatest(0, tools_before - tools_after))::BIGINT AS tools_removed FROM requests)"""


@query(f"""{_STATS_SQL} SELECT *, floor(latency_ms / total + 0.5)::BIGINT AS avg_latency_ms, floor((1 - tokens_after / tokens_before) * 100 + 0.5)::BIGINT AS saved_pct, floor(total / 3600 * 60 + 0.5)::BIGINT AS per_minute FROM s""")
def request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.derived_stats(telemetry.request_stats(t.requests(spark, sf_dir)), 3600)


@query(f"""{_STATS_SQL.replace("FROM requests)", "FROM requests WHERE ts >= (SELECT min(ts) + INTERVAL 1 HOUR FROM events))")} SELECT * FROM s""")
def stats_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.requests(spark, sf_dir)
    start = r.agg((F.min("ts") + F.expr("INTERVAL 1 HOUR")).alias("t")).first()["t"]
    return telemetry.request_stats(telemetry.since(r, F.lit(start).cast("timestamp_ntz") if start else None))


@query(f"""WITH {t.REQUESTS_SQL}, l AS (SELECT list_sort(list(latency_ms)) AS v FROM (SELECT latency_ms FROM requests ORDER BY ts DESC, id DESC LIMIT 100)) SELECT len(v) AS n, v[(len(v) * 0.5)::INT + 1] AS p50 FROM l""".replace("(len(v) * 0.5)::INT", "floor(len(v) * 0.5)::INT"))
def latency_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.upper_median(t.requests(spark, sf_dir), "latency_ms", order=("ts", "id"))


_FLOW = "greatest(0, tokens_raw - tokens_before) AS ide_removed, greatest(0, tokens_after - tokens_before) AS injected, greatest(0, tokens_before + greatest(0, tokens_after - tokens_before) - tokens_after) AS budget_cut, CASE WHEN tokens_raw > 0 THEN floor((tokens_raw - tokens_after) / tokens_raw * 100 + 0.5)::BIGINT ELSE 0 END AS saved_pct"


@query(f"WITH {t.REQUESTS_SQL} SELECT id, {_FLOW} FROM (SELECT * FROM requests ORDER BY ts DESC, id DESC LIMIT 20)")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.token_flow(telemetry.latest(t.requests(spark, sf_dir), 20, "ts", "id"))


@query(f"""WITH {t.REQUESTS_SQL}, n AS (SELECT id, CASE WHEN id % 4 = 0 THEN tokens_before ELSE tokens_raw END AS tokens_raw, tokens_before, CASE WHEN id % 6 = 0 THEN tokens_before ELSE tokens_after END AS tokens_after FROM requests) SELECT id, {_FLOW} FROM n""")
def token_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.requests(spark, sf_dir)
    return telemetry.token_flow(r.withColumn("tokens_raw", F.when(F.col("id") % 4 != 0, F.col("tokens_raw"))).withColumn("tokens_after", F.when(F.col("id") % 6 != 0, F.col("tokens_after"))))


_LINES = ("[Error] x", "Failed to run", "[System] Starting Core Daemon", "[System] Starting", "[Core] ok", "Indexed batch 3", "[MLX] load", "Gateway up", "Reranker ready", "rerank done", "index empty", "nothing", "Daemon ready [Core]", "Background indexing ❌", "error in lower case")
_LINES_SQL = "lines AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN '[Error] ' WHEN 'purchase' THEN '[Core] Indexed batch ' WHEN 'view' THEN 'Gateway ' ELSE '' END || 'user ' || user_id AS line FROM events UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{x}')" for i, x in enumerate(_LINES)) + ") v(seq, line))"
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN {_any_sql(m, 'line')} THEN '{c}'" for c, m in rules.LOG_CATEGORIES) + " ELSE 'all' END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    mark = F.when(F.col("event_type") == "error", "[Error] ").when(F.col("event_type") == "purchase", "[Core] Indexed batch ").when(F.col("event_type") == "view", "Gateway ").otherwise("")
    own = e.select(F.col("event_id").alias("seq"), F.concat(mark, F.lit("user "), F.col("user_id").cast("string")).alias("line"))
    return own.unionByName(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(_LINES)], "seq long, line string"))


@query(f"WITH {_LINES_SQL} SELECT seq, {_CATEGORY_SQL} AS category FROM lines")
def log_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("seq", rules.log_category("line").alias("category"))


@query(f"WITH {_LINES_SQL}, c AS (SELECT {_CATEGORY_SQL} AS category FROM lines) SELECT category, count(*) AS n FROM c WHERE category <> 'all' GROUP BY category UNION ALL SELECT 'all', count(*) FROM c")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.log_counts(_lines(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id AS seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT seq, line FROM (SELECT seq, pos, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' ORDER BY seq DESC, pos DESC LIMIT 200)""")
def log_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.log_ring(t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")).select("seq", "line")


@query("""WITH x AS (SELECT event_id // 20 AS request_id, epoch_us(ts) // 1000 AS t_ms, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS token FROM events),
r AS (SELECT request_id, count(*) FILTER (WHERE token) AS tokens, min(t_ms) AS first, max(t_ms) AS last FROM x GROUP BY request_id)
SELECT request_id, tokens, 25::BIGINT AS ttft_ms, CASE WHEN (last - first) / 1000 > 0.1 THEN floor(tokens / ((last - first) / 1000) + 0.5)::BIGINT ELSE 0 END AS tps FROM r""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    i = F.col("event_id")
    body = F.when(i % 5 == 0, "data: [DONE]").when(i % 7 == 0, "data: {broken").when(i % 11 == 0, 'data: {"choices":[{"delta":{"content":"","reasoning_content":"x"}}]}').when(i % 13 == 0, 'data: {"choices":[{"delta":{"reasoning_content":"hm"}}]}').otherwise(' data:{"choices":[{"delta":{"content":"w"}}]} ')
    rows = e.select(F.floor(i / 20).alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), body.alias("line"))
    first = rows.groupBy("request_id").agg((F.min("t_ms") - 25).alias("start_ms"))
    return telemetry.stream_metrics(rows.join(first, "request_id"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last FROM s GROUP BY user_id, k""")
def stats_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = telemetry.sessions(e)
    return s.select("user_id", "n", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"))


@query(f"""WITH {t.REQUESTS_SQL} SELECT id, round(avg(latency_ms) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS ring_latency FROM requests""")
def running_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.running(t.requests(spark, sf_dir).select("id", "ts", "user_id", "latency_ms"), key="user_id").select("id", F.round("ring_latency", 6).alias("ring_latency"))


@query(f"""WITH {t.REQUESTS_SQL} SELECT id, round(avg(latency_ms) OVER (ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS ring_latency FROM requests""")
def running_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last hundred latencies at every request, all requests being one ring."""
    return telemetry.running(t.requests(spark, sf_dir).select("id", "ts", "latency_ms")).select("id", F.round("ring_latency", 6).alias("ring_latency"))


@query("""WITH b AS (SELECT event_id, floor(value)::BIGINT * event_id AS n, event_id * 37 AS s FROM events)
SELECT event_id, CASE WHEN n < 100 THEN 'fast' WHEN n < 300 THEN 'fair' ELSE 'slow' END AS latency, concat_ws(' ', CASE WHEN s >= 3600 THEN (s // 3600) || 'h' END, CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' END, (s % 60) || 's') AS uptime,
CASE WHEN event_id % 3 = 0 THEN 'busy' WHEN event_id % 3 = 1 THEN 'ready' ELSE 'waiting' END AS state FROM b""")
def buckets_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = t.read(spark, sf_dir, "events").select("event_id", (F.floor("value").cast("long") * i).alias("n"), (i * 37).alias("s"), F.when(i % 3 == 0, 1).otherwise(0).alias("pending"), F.when(i % 3 == 1, 1).otherwise(0).alias("indexed"))
    return e.select("event_id", rules.latency_bucket("n").alias("latency"), rules.uptime_text("s").alias("uptime"), rules.index_state("pending", "indexed").alias("state"))


@query("""WITH e AS (SELECT event_id, floor(value)::BIGINT AS n, event_id * 37 AS s, (['[Error] x', 'a Failed b', 'Exception', 'x [MLX] y', '[Core] up', 'error [mlx] [core]'])[(event_id % 6)::BIGINT + 1] AS line FROM events)
SELECT event_id, CASE WHEN n * n < 1024 THEN n * n || ' B' WHEN n * n < 1048576 THEN format('{:.1f} KB', floor(n * n / 1024 * 10 + 0.5) / 10) ELSE format('{:.2f} MB', floor(n * n / 1048576 * 100 + 0.5) / 100) END AS size,
CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS uptime,
CASE WHEN s >= 60 THEN s // 60 || 'm ' ELSE '' END || s % 60 || 's' AS total_time, (n + s + 5) // 1000 || '.' || lpad(((n + s + 5) // 10 % 100)::VARCHAR, 2, '0') || 's' AS context_s,
CASE WHEN line LIKE '%[Error%' OR line LIKE '%Exception%' OR line LIKE '%Failed%' THEN 'error' WHEN line LIKE '%[MLX]%' THEN 'model' WHEN line LIKE '%[Core]%' THEN 'core' ELSE 'plain' END AS colour,
rpad(event_id::VARCHAR, greatest(8, length(event_id::VARCHAR))::INTEGER, ' ') AS left_text, lpad(event_id::VARCHAR, greatest(8, length(event_id::VARCHAR))::INTEGER, ' ') AS right_text FROM e""")
def dashboard_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    line = F.element_at(F.array(*[F.lit(x) for x in ("[Error] x", "a Failed b", "Exception", "x [MLX] y", "[Core] up", "error [mlx] [core]")]), (i % 6 + 1).cast("int"))
    e = t.read(spark, sf_dir, "events").select("event_id", F.floor("value").cast("long").alias("n"), (i * 37).alias("s"), line.alias("line"))
    return e.select("event_id", rules.short_bytes_text(F.col("n") * F.col("n")).alias("size"), rules.short_uptime_text("s").alias("uptime"), rules.total_time_text("s").alias("total_time"), rules.context_seconds_text("n", "s").alias("context_s"), rules.log_colour("line").alias("colour"), rules.padded("event_id", 8).alias("left_text"), rules.padded("event_id", 8, right=True).alias("right_text"))


@query(f"""WITH {t.MANIFEST_SQL}, {t.REQUESTS_SQL} SELECT (SELECT count(*) FROM manifest) AS files, (SELECT count(*) FROM diff WHERE status IN ('NEW', 'CHANGED')) AS pending,
(SELECT count(*) FROM manifest WHERE ast_version = 1 AND rag_version = 1 AND has_chunk) AS nodes, (SELECT floor(epoch_us(TIMESTAMP '2030-01-01' - max(ts)) / 1000000)::BIGINT FROM requests) AS last_s""")
def daemon_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = t.manifest(spark, sf_dir)
    counts = telemetry.daemon_status(manifest, index.startup_queue(index.manifest_diff(t.snapshot(spark, sf_dir), manifest)), index.hydrated(manifest))
    return counts.join(telemetry.last_request_age(t.requests(spark, sf_dir), F.lit("2030-01-01").cast("timestamp_ntz")))  # two single rows


# --- import graph --------------------------------------------------------------------------------------------------


@query(f"WITH {t.DAG_SQL} SELECT src, count(*) AS cross_file_imports FROM edges GROUP BY src")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_imports(t.dag(spark, sf_dir)[1])


#: Specifiers of document i: two that resolve, by suffix and as a folder, a package, one whose suffix is there already, one that means nothing.
_IMPORT_SQL = """files AS (SELECT DISTINCT '/src/a/' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.tsx' WHEN doc_id % 4 = 1 THEN '/index.ts' WHEN doc_id % 4 = 2 THEN '.d.ts' ELSE '.ts' END AS path, doc_id FROM documents),
imports AS (SELECT path, pos, base FROM files, LATERAL (VALUES (0, '/src/a/' || (doc_id + 1)), (1, '/src/a/' || (doc_id // 2)), (3, '/src/a/' || doc_id || '.ts'), (4, '/src/lib/' || doc_id || '.js')) v(pos, base) WHERE NOT path LIKE '%index.ts'
  UNION ALL SELECT path, pos, base FROM files, LATERAL (VALUES (0, '/src/a/' || doc_id || '/' || (doc_id + 1)), (1, '/src/a/' || (doc_id // 2)), (3, '/src/a/' || doc_id || '/' || doc_id || '.ts'), (4, '/src/a/lib/' || doc_id || '.js')) v(pos, base) WHERE path LIKE '%index.ts'),
tried AS (SELECT path, pos, n, CASE WHEN base LIKE '%' || x THEN base ELSE base || x END AS c FROM imports, (VALUES (0, '.ts'), (1, '.tsx'), (2, '/index.ts'), (3, '/index.tsx'), (4, '.d.ts')) s(n, x))"""


def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    suffix = F.when(i % 4 == 0, ".tsx").when(i % 4 == 1, "/index.ts").when(i % 4 == 2, ".d.ts").otherwise(".ts")
    files = t.read(spark, sf_dir, "documents").select("doc_id").distinct().select(F.concat(F.lit("/src/a/"), i.cast("string"), suffix).alias("path"), "doc_id")
    inside = i % 4 == 1  # lies one folder deeper
    s = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    up = F.when(inside, "../").otherwise("./")
    specs = F.array(s("./", (i + 1).cast("string")), s(up, "x/.././", F.floor(i / 2).cast("string")), F.lit("react"), s("./", i.cast("string"), ".ts"), s("../lib/", i.cast("string"), ".js"))
    return files.select(F.col("path").alias("file_path"), F.posexplode(specs).alias("pos", "specifier")), files


@query(f"WITH {_IMPORT_SQL} SELECT t.path AS src, t.pos, arg_min(c, n) AS dst FROM tried t JOIN files f ON f.path = c GROUP BY t.path, t.pos")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports, files = _imports(spark, sf_dir)
    return graph.graph_edges(imports, files, files)


@query(f"WITH {_IMPORT_SQL} SELECT DISTINCT c AS path, t.path AS importer FROM tried t JOIN files f ON f.path = c")
def potential_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports, files = _imports(spark, sf_dir)
    return graph.potential_importers(imports, files)


@query(f"WITH RECURSIVE {t.DAG_SQL}, r(node) AS (SELECT node FROM nodes WHERE node IN (5, 7) UNION SELECT src FROM r JOIN edges ON dst = r.node) SELECT node FROM r")
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = t.dag(spark, sf_dir)
    return graph.reachable(edges, nodes.filter("node IN (5, 7)")).select("node")


_DEPTH_SQL = f"{t.DAG_SQL}, walk(node, depth) AS (SELECT node, 0 FROM nodes UNION SELECT src, depth + 1 FROM walk JOIN edges ON dst = walk.node), depths AS (SELECT node, max(depth)::BIGINT AS depth FROM walk GROUP BY node)"


@query(f"WITH RECURSIVE {_DEPTH_SQL} SELECT node, depth FROM depths")
def graph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = t.dag(spark, sf_dir)
    return graph.depths(edges, nodes)


#: The graph with an edge back from some documents to their double: each closes a cycle, and other edges lead from one cycle to the next.
_CYCLES_SQL = f"""{t.DAG_SQL}, lines AS (SELECT src, dst FROM edges UNION SELECT node, 2 * node FROM nodes WHERE node % 11 = 3 AND 2 * node IN (SELECT node FROM nodes)),
r(a, b) AS (SELECT src, dst FROM lines UNION SELECT r.a, dst FROM r JOIN lines ON src = r.b),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
refs AS (SELECT node, component, (SELECT count(*) FROM lines JOIN r ON r.a = dst AND r.b = src WHERE src = node) AS cyclic_refs FROM c),
ends AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM c) AND node NOT IN (SELECT a FROM r WHERE b IN (SELECT node FROM c)))"""


def _cyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = t.dag(spark, sf_dir)
    back = nodes.filter("node % 11 = 3").select(F.col("node").alias("src"), (F.col("node") * 2).alias("dst")).hint("merge").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes, edges.select("src", "dst").unionByName(back.select("src", "dst")).distinct()


@query(f"WITH RECURSIVE {_CYCLES_SQL} SELECT node, component, cyclic_refs FROM refs")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components, and how many edges of each node lie within one."""
    nodes, edges = _cyclic(spark, sf_dir)
    found = written(graph.components(edges, nodes), "cycles")
    return found.hint("merge").join(graph.cyclic_refs(edges, found), "node")


@query(f"""WITH RECURSIVE {_CYCLES_SQL}, walk(node, depth) AS (SELECT node, 0 FROM ends UNION SELECT src, depth + 1 FROM walk JOIN lines ON dst = walk.node WHERE src IN (SELECT node FROM ends))
SELECT (SELECT max(depth) FROM walk)::BIGINT AS max_depth, (SELECT count(*) FROM lines) AS cross_file_refs, (SELECT sum(cyclic_refs)::BIGINT FROM refs) AS cyclic_edges, (SELECT sum(node % 5)::BIGINT FROM nodes) AS symbols""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _cyclic(spark, sf_dir)
    edges = written(edges, "cyclic-edges")
    cross = graph.cross_imports(edges).withColumnRenamed("src", "node")
    refs = graph.cyclic_refs(edges, written(graph.components(edges, nodes), "cycles"))
    rows = graph.depths(edges, nodes).hint("merge").join(cross, "node", "left").hint("merge").join(refs, "node", "left").select("depth", "cross_file_imports", "cyclic_refs", (F.col("node") % 5).alias("exports"))
    return graph.graph_summary(rows)


_LESS_SQL = f"""{t.DAG_SQL.replace("edges AS (", "old_edges AS (")},
edges AS (SELECT * FROM old_edges WHERE NOT (src % 7 = 3 AND pos = 0)), walk(node, depth) AS (SELECT node, 0 FROM nodes UNION SELECT src, depth + 1 FROM walk JOIN edges ON dst = walk.node)"""


@query(f"WITH RECURSIVE {_LESS_SQL} SELECT node, max(depth)::BIGINT AS depth FROM walk GROUP BY node")
def graph_depth_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some edges go; depths follow the changes from their sources on, over the old ones."""
    nodes, edges = t.dag(spark, sf_dir)
    now = edges.filter("NOT (src % 7 = 3 AND pos = 0)")
    old = written(graph.depths(edges, nodes), "old-depths")
    new = graph.maintained(now, old, edges.filter("src % 7 = 3").select(F.col("src").alias("node")))
    return old.hint("merge").join(new.withColumnRenamed("depth", "now"), "node", "left").select("node", F.coalesce("now", "depth").alias("depth"))


@query(f"""WITH RECURSIVE {_IMPORT_SQL}, all_edges AS (SELECT t.path AS src, t.pos, arg_min(c, n) AS dst FROM tried t JOIN files f ON f.path = c WHERE t.pos IN (1, 4) AND t.path NOT IN (SELECT path FROM files WHERE doc_id = 0) GROUP BY t.path, t.pos),
walk(path, depth) AS (SELECT path, 0 FROM files UNION SELECT src, depth + 1 FROM walk JOIN all_edges ON dst = walk.path)
SELECT f.path, (SELECT count(*) FROM all_edges e WHERE e.src = f.path) AS cross_file_imports, (SELECT max(depth) FROM walk w WHERE w.path = f.path)::BIGINT AS depth FROM files f""")
def graph_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the files come anew to a graph without them: what could mean them is resolved again, and depths follow."""
    imports, files = _imports(spark, sf_dir)
    imports = imports.filter("pos IN (1, 2, 4)").hint("merge").join(files.filter("doc_id = 0").select(F.col("path").alias("file_path")), "file_path", "left_anti")
    new = files.filter("doc_id % 10 = 6").select("path")
    before = files.hint("merge").join(new, "path", "left_anti").select("path")
    edges = written(graph.graph_edges(imports.hint("merge").join(before.withColumnRenamed("path", "file_path"), "file_path", "left_semi"), before, before), "old-edges")
    depth = written(graph.depths(edges, before.select(F.col("path").alias("node"))), "old-depths").withColumnRenamed("node", "path")
    zero = F.lit(0).cast("long")
    known = depth.hint("merge").join(graph.cross_imports(edges).withColumnRenamed("src", "path"), "path", "left").select("path", "depth", F.coalesce("cross_file_imports", zero).alias("cross_file_imports"), F.lit(1).alias("cyclic_refs"), F.lit(1).alias("exports"))
    nodes = known.unionByName(new.select("path", zero.alias("depth"), zero.alias("cross_file_imports"), F.lit(0).alias("cyclic_refs"), F.lit(1).alias("exports")))
    return graph.updated(nodes, edges, imports, files, new).nodes.select("path", "cross_file_imports", "depth")


@query()
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects of 500 files, each importing those at half and a third of its place in the project."""
    d = t.read(spark, sf_dir, "documents").select("doc_id").distinct().select("doc_id", F.floor(F.col("doc_id") / 500).alias("project"), (F.col("doc_id") % 500).alias("node"))
    lines = d.select("project", F.col("node").alias("src"), F.posexplode(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3))).alias("pos", "dst")).filter("src != dst")
    edges = lines.join(d.select("project", F.col("node").alias("dst")), ["project", "dst"], "left_semi")
    return graph.walked_metrics(edges, d.select("project", "node"))
