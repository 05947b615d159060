"""How the driver's tables are read as snapshots, requests, messages and graphs. The SQL of each mapping stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(id_col: str = "doc_id"):
    return F.concat(F.lit("/src/"), F.col(id_col).cast("string"), F.lit(".ts"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("doc_id % 9 != 4")
    return d.select(path_of().alias("path"), F.col("n_chars").cast("double").alias("mtime"), F.col("n_chars").alias("size"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("doc_id % 10 != 3")
    when = lambda k, a, b: F.when(F.col("doc_id") % k == 0, a).otherwise(b)
    return d.select(path_of().alias("path"), F.col("n_chars").cast("double").alias("mtime"), (F.col("n_chars") + when(7, 1, 0)).alias("size"), when(11, 0, 1).alias("ast_version"), F.lit(1).alias("rag_version"), (F.col("doc_id") % 13 != 0).alias("has_chunk"))


MANIFEST_SQL = """
snapshot AS (SELECT '/src/' || doc_id || '.ts' AS path, n_chars::DOUBLE AS mtime, n_chars AS size FROM documents WHERE doc_id % 9 <> 4),
manifest AS (SELECT '/src/' || doc_id || '.ts' AS path, n_chars::DOUBLE AS mtime, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS ast_version, 1 AS rag_version, doc_id % 13 <> 0 AS has_chunk FROM documents WHERE doc_id % 10 <> 3),
diff AS (SELECT coalesce(s.path, m.path) AS path, s.mtime AS s_mtime,
  CASE WHEN m.path IS NULL THEN 'NEW' WHEN s.path IS NULL THEN 'DELETED'
    WHEN s.mtime = m.mtime AND s.size = m.size AND ast_version = 1 AND rag_version = 1 AND has_chunk THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
  FROM snapshot s FULL JOIN manifest m ON s.path = m.path)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the value is the latency, token and tool counts follow from it."""
    ms = F.floor("value").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", (F.col("event_type") != "error").alias("ok"), ms.alias("latency_ms"),
        (ms * 10).alias("tokens_raw"), (ms * 7).alias("tokens_before"), (ms * 5 + F.col("event_id") % 50).alias("tokens_after"),
        (F.col("event_id") % 9).alias("tools_before"), (F.col("event_id") % 5).alias("tools_after"), "user_id",
    )


REQUESTS_SQL = """
requests AS (SELECT event_id AS id, ts, event_type <> 'error' AS ok, floor(value)::BIGINT AS latency_ms, floor(value)::BIGINT * 10 AS tokens_raw, floor(value)::BIGINT * 7 AS tokens_before,
  floor(value)::BIGINT * 5 + event_id % 50 AS tokens_after, event_id % 9 AS tools_before, event_id % 5 AS tools_after, user_id FROM events)"""

#: Messages that the conversations lack: (conv_id, turn, content) of system messages, one per rule at least.
BLOCKS = (
    (-1, 0, "You are careful."),
    (-1, 1, "<diagnostics> x.ts: TypeScript error at 3 </diagnostics>"),
    (-1, 2, "<terminal> ok </terminal>"),
    (-1, 3, "├ a ├ b ├ c ├ d ├ e ├ f │ g │ h │ i └ j └ k"),
    (-1, 4, "<environment_details>\nActive file: /src/App.tsx\nnothing here\ncursor position: line 42\nOS: linux\n</environment_details>"),
    (-1, 5, '<file_content path="/src/App.tsx">\nlet a = 1\n</file_content>'),
    (-1, 6, "plain note"),
    (-2, 0, "persona again"),
    (-2, 1, "open tabs without anything of use"),
    (-2, 2, "# notes.md\n```\ncode\n```"),
    (-2, 3, "<TREE> a b c </TREE>"),
    (-2, 4, "eslint says no"),
    (-2, 5, "see line 7, column 2"),
    (-2, 6, "ten ├├├├├├├├├├ only"),
    (-2, 7, "eleven ├├├├├├├├├├├"),
)
#: The same repeated to lie on both sides of each size limit: (conv_id, turn, text, times).
LONG = ((-3, 0, "p", 1), (-3, 1, "<terminal>ab", 199), (-3, 2, "<terminal>ab", 200), (-3, 3, "u23456789 ", 799), (-3, 4, "u23456789 ", 800), (-3, 5, "```456789 ", 1599), (-3, 6, "```456789 ", 1600))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    more = [(c, t, "system", x) for c, t, x in BLOCKS] + [(c, t, "system", x * n) for c, t, x, n in LONG]
    return own.unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, content string"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


MESSAGES_SQL = (
    "messages AS (SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT c::BIGINT, t::BIGINT, 'system', x FROM (VALUES "
    + ", ".join(f"({c}, {t}, {_quoted(x)})" for c, t, x in BLOCKS)
    + ") v(c, t, x) UNION ALL SELECT c::BIGINT, t::BIGINT, 'system', repeat(x, n) FROM (VALUES "
    + ", ".join(f"({c}, {t}, {_quoted(x)}, {n})" for c, t, x, n in LONG)
    + ") v(c, t, x, n))"
)


def dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every document depends on half and a third of its id; 1, which would be its own third's half, ends in 0."""
    d = read(spark, sf_dir, "documents").select("doc_id").distinct()
    two = d.select(F.col("doc_id").alias("src"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.floor(F.col("doc_id") / 2).alias("dst")), F.struct(F.lit(1).alias("pos"), F.floor(F.col("doc_id") / 3).alias("dst")))).alias("e"))
    edges = two.select("src", "e.pos", "e.dst").filter("src != dst")
    return d.select(F.col("doc_id").alias("node")), edges.hint("merge").join(d.select(F.col("doc_id").alias("dst")), "dst", "left_semi").select("src", "pos", "dst")


DAG_SQL = """
nodes AS (SELECT DISTINCT doc_id AS node FROM documents),
edges AS (SELECT src, pos, dst FROM (SELECT node AS src, 0 AS pos, node // 2 AS dst FROM nodes UNION ALL SELECT node, 1, node // 3 FROM nodes) WHERE src <> dst AND dst IN (SELECT node FROM nodes))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored candidates of four tasks."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.col("doc_id") % 4).alias("task_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "text", path_of().alias("file_path"), (F.col("quality") + (F.col("doc_id") % 7) / 8).alias("score"))


CANDIDATES_SQL = "candidates AS (SELECT d.doc_id % 4 AS task_id, d.doc_id AS pos, d.doc_id::VARCHAR AS id, text, '/src/' || d.doc_id || '.ts' AS file_path, quality + (d.doc_id % 7) / 8.0::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
