"""Message engineering over (conv_id, turn, role, content): classify, filter, compact, inject and trim, batched over conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.rules import block_kept, block_kind, keeps_tool
from ..functions.text import active_path_in, block_tokens, compacted_environment, cursor_line, fallback_tokens, message_text
from ..sources.scratch import ship

PARTS = "array<struct<type:string,text:string>>"


def task_text(messages: DataFrame, most: int = 500) -> DataFrame:
    """(conv_id, task): the last user message's first ``most`` characters. Content that is a JSON list of parts counts by its
    first text part, if that has text; otherwise an earlier message is looked at. Conversations without any have an empty task."""
    parts = F.from_json(F.when(F.col("content").startswith("["), F.col("content")), PARTS)
    texts = F.filter(parts, lambda p: p["type"] == "text")
    is_list = parts.isNotNull() & (F.size(parts) > 0)
    text = F.when(is_list, F.nullif(F.coalesce(F.get(texts, F.lit(0))["text"], F.lit("")), F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    found = F.when(F.col("role") == "user", F.substring(text, 1, most))
    return messages.groupBy("conv_id").agg(F.max_by(found, F.when(found.isNotNull(), F.col("turn"))).alias("t")).select("conv_id", F.coalesce("t", F.lit("")).alias("task"))


def classified(messages: DataFrame) -> DataFrame:
    """Messages with system_index, kind, kept and final content; other roles have none of these and stay as they are.

    Both kinds of file blocks are dropped, as retrieval brings files in its own way.
    """
    is_system = F.col("role") == "system"
    index = F.count(F.when(is_system, 1)).over(W.partitionBy("conv_id").orderBy("turn")) - 1
    kind = F.when(is_system, block_kind("content", "system_index"))
    small = F.when(F.col("kind") == "environment", compacted_environment("content")).otherwise(F.col("content"))
    out = messages.withColumn("system_index", F.when(is_system, index)).withColumn("kind", kind)
    kept = ~is_system | (block_kept("kind", "content") & ~F.col("kind").isin("active_file", "other_file"))
    return out.withColumn("kept", kept).withColumn("final", F.when(F.col("kept"), F.when(is_system, small).otherwise(F.col("content"))))


def engineered(messages: DataFrame) -> DataFrame:
    """Per conversation: tokens before and after, dropped blocks, counts per kind, and the last active path and cursor line named."""
    c = classified(messages)
    system = F.when(F.col("role") == "system", F.col("content"))
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("turn")))
    kinds = ("persona", "diagnostics", "terminal", "workspace_tree", "environment", "active_file", "other_file", "unknown")
    return c.groupBy("conv_id").agg(
        F.sum(block_tokens(F.coalesce("content", F.lit("")))).alias("tokens_raw"),
        F.coalesce(F.sum(F.when(F.col("kept"), block_tokens(F.coalesce("final", F.lit(""))))), F.lit(0)).cast("long").alias("tokens_engineered"),
        F.count_if(~F.col("kept")).alias("blocks_dropped"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
        last(active_path_in(system)).alias("active_path"),
        last(cursor_line(system)).alias("cursor_line"),
    )


def kept_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) after filtering and compaction."""
    return classified(messages).filter("kept").select("conv_id", "turn", "role", F.col("final").alias("content"))


def context_message(think: Column, ast: Column, rag: Column, tag: str = "context", mark: str = "/think") -> Column:
    """Text of the message to inject; null if there is nothing to say."""
    wrapped = F.when(ast.isNotNull() & (ast != ""), F.concat_ws("\n", F.lit(f"<{tag}>"), ast, F.nullif(rag, F.lit("")), F.lit(f"</{tag}>")))
    return F.nullif(F.concat_ws("\n", F.when(think, F.lit(mark)), wrapped), F.lit(""))


def injected(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """Messages with each conversation's context (conv_id, context) as a system message after its first system message, or in front; turns are numbered anew from 0."""
    first = messages.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("at"))
    new = contexts.filter(F.col("context").isNotNull() & (F.col("context") != "")).join(first, "conv_id")
    front = F.struct(F.coalesce("at", F.lit(-(1 << 60))).alias("turn"), F.lit(1).alias("after"))
    rows = messages.select("conv_id", F.struct("turn", F.lit(0).alias("after")).alias("place"), "role", "content")
    rows = rows.unionByName(new.select("conv_id", front.alias("place"), F.lit("system").alias("role"), F.col("context").alias("content")))
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("place")) - 1
    return rows.select("conv_id", nth.cast("long").alias("turn"), "role", "content")


def trimmed(messages: DataFrame, budget: int, tokens: Column | None = None) -> DataFrame:
    """Messages after dropping, from the second on, as few as bring a conversation into its budget; the first and the last stay.

    Dropping the second message again and again is dropping the shortest run after the first whose rest fits: a message
    stays if what follows it up to the end, with itself and the first, fits.
    """
    w = W.partitionBy("conv_id")
    n = fallback_tokens(message_text("role", "content")) if tokens is None else tokens
    rows = messages.withColumn("tokens", n).withColumn("nth", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    rest = F.sum("tokens").over(w.orderBy("turn").rowsBetween(0, W.unboundedFollowing)) + F.max(F.when(F.col("nth") == 1, F.col("tokens"))).over(w)
    fits = (F.col("nth") == 1) | (F.col("nth") == F.col("n")) | (F.col("rest") <= budget)
    return rows.withColumn("rest", rest).filter(fits).select("conv_id", "turn", "role", "content", "tokens")


def shaped_tools(tools: DataFrame, tasks: DataFrame) -> DataFrame:
    """(conv_id, pos, name) of the tools that a request keeps."""
    return tools.join(tasks, "conv_id", "left").filter(keeps_tool("task", "name")).select("conv_id", "pos", "name")


def payloads(bodies: DataFrame, messages: DataFrame, tools: DataFrame | None = None, keep_alive: int = -1) -> DataFrame:
    """(conv_id, payload): the JSON text that is sent on for each request.

    bodies: conv_id, stream and whatever else the request said, in this order. messages: conv_id, turn, role, content, as
    they go on. tools: conv_id, pos, name, kept ones; a request without any has no tools field. Fields that are null are left out.
    """
    said = messages.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    out = bodies.join(said, "conv_id")
    if tools is not None:
        kept = tools.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("tools"))
        out = out.join(kept, "conv_id", "left")
    fields = [c for c in bodies.columns if c not in ("conv_id", "messages", "tools", "stream", "keep_alive")]
    last = ["tools"] if tools is not None else []
    return out.select("conv_id", F.to_json(F.struct(*fields, "messages", "stream", F.lit(keep_alive).alias("keep_alive"), *last)).alias("payload"))


def token_counter(load: Callable[[], Callable[[str], int]]):
    """A tokenizer's count of a text as an iterator UDF: ``load`` makes the counting function once per task.

    Where it can't be loaded, or fails on a text, that text counts as a quarter of its UTF-16 units, cut, as ``text.fallback_tokens`` does.
    A null text has none. Use it over ``text.message_text`` for messages.
    """
    ship(SparkSession.active())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            own = load()
        except Exception:  # noqa: BLE001  a tokenizer may be missing where a task runs
            own = None

        def one(text: str | None) -> int:
            try:
                return int(own(text or ""))
            except Exception:  # noqa: BLE001
                return len((text or "").encode("utf-16-le", "surrogatepass")) // 8

        for batch in batches:
            yield batch.map(one).astype("int64")

    return count
