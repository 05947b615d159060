"""Ordered first-match rules: kinds of system messages, categories of log lines, buckets and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _any_of, block_tokens, col, compacted_environment, file_path_in, round_half_up

#: Marks of each kind of block, on lower-cased text, in the order they are tried (fixed values).
DIAGNOSTICS = ("<diagnostics>", "<errors>", "<lsp_diagnostics>", "typescript error", "eslint")
TERMINAL = ("<terminal>", "<terminal_output>")
TREE = ("<workspace_items>", "<tree>", "<folder_structure>", "<file_list>")
ENVIRONMENT = ("<environment_details>", "<open_tabs>", "open tabs", "vscode", "cursor position")
FILE = ("<file_content>", "```")
BOX = "[├└│]"

#: Marks of each category of log lines, case-sensitive, in the order they are tried (fixed values).
LOG_CATEGORIES = (
    ("error", ("[Error", "Exception", "Failed", "❌")),
    ("startup", ("[System] Starting", "Starting MLX server", "Daemon ready", "Initializing engines")),
    ("core", ("[System] Starting Core Daemon", "[Core]", "Index diff", "Indexed batch", "Background indexing")),
    ("mlx", ("[MLX]",)),
    ("gateway", ("[Gateway]", "Gateway")),
    ("rerank", ("Reranker", "[Reranker]", "rerank")),
    ("index", ("index", "Index")),
)

#: Names of tools that touch files or the net, and words of tasks that need them (fixed values).
IO_TOOLS = r"(?i)^(read_file|write_file|list_dir|web_search|browser|fetch|http)"
TASK_ACTIONS = r"(?i)\b(create|write|file|search|fetch|open)\b"


def block_kind(content: str | Column, system_index: str | Column) -> Column:
    """Kind of a system message by the first rule that holds; the first one of a conversation is the persona."""
    text, low, est = col(content), F.lower(col(content)), block_tokens(content)
    return (
        F.when(col(system_index) == 0, F.lit("persona"))
        .when(_any_of(low, DIAGNOSTICS), F.lit("diagnostics"))
        .when(_any_of(low, TERMINAL), F.lit("terminal"))
        .when(_any_of(low, TREE) | (F.regexp_count(text, F.lit(BOX)) > 10), F.lit("workspace_tree"))
        .when(_any_of(low, ENVIRONMENT), F.lit("environment"))
        .when(file_path_in(text).isNotNull() | _any_of(low, FILE), F.when(est < 4000, F.lit("active_file")).otherwise(F.lit("other_file")))
        .otherwise(F.lit("unknown"))
    )


def block_kept(kind: str | Column, content: str | Column) -> Column:
    """Whether the classifier keeps a block; files are dropped later, when context is engineered."""
    k, est = col(kind), block_tokens(content)
    return (
        F.when(k.isin("persona", "diagnostics", "active_file"), F.lit(True))
        .when(k == "terminal", est < 600)
        .when(k == "environment", compacted_environment(content).isNotNull())
        .when(k == "unknown", est < 2000)
        .otherwise(F.lit(False))
    )


def log_category(line: str | Column) -> Column:
    out = None
    for name, marks in LOG_CATEGORIES:
        hit = _any_of(col(line), marks)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("all"))


def log_level(line: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(line), r"(ERROR|WARN|INFO|DEBUG)", 1), F.lit(""))


def keeps_tool(task: str | Column, tool: str | Column) -> Column:
    """A tool stays if the task asks for an action or the tool isn't one for files or the net."""
    return F.coalesce(col(task), F.lit("")).rlike(TASK_ACTIONS) | ~F.coalesce(col(tool), F.lit("")).rlike(IO_TOOLS)


def latency_bucket(ms: str | Column) -> Column:
    return F.when(col(ms) < 100, F.lit("fast")).when(col(ms) < 300, F.lit("fair")).otherwise(F.lit("slow"))


def index_state(pending: str | Column, indexed: str | Column) -> Column:
    return F.when(col(pending) > 0, F.lit("busy")).when(col(indexed) > 0, F.lit("ready")).otherwise(F.lit("waiting"))


def bytes_text(n: str | Column) -> Column:
    """1024-based size with up to two decimals; nothing or null is ``0 B``."""
    x = F.coalesce(col(n), F.lit(0)).cast("double")
    i = F.when(x >= 1024.0**3, 3).when(x >= 1024.0**2, 2).when(x >= 1024.0, 1).otherwise(0)
    scaled = F.format_string("%.2f", x / F.pow(F.lit(1024.0), i))
    plain = F.regexp_replace(F.regexp_replace(scaled, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, F.lit("0 B")).otherwise(F.concat(plain, F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), i + 1)))


def uptime_text(seconds: str | Column) -> Column:
    """Hours and minutes where there are some, and seconds."""
    s = F.coalesce(col(seconds), F.lit(0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    return F.concat_ws(" ", part(h, "h"), part(m, "m"), F.concat((s % 60).cast("string"), F.lit("s")))


def bar(value: str | Column, most: str | Column, width: int = 20) -> Column:
    """A text bar of ``width`` cells."""
    filled = F.when(col(most) > 0, F.greatest(F.lit(0), F.least(F.lit(width), round_half_up(col(value) / col(most) * width)))).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def short_bytes_text(n: str | Column) -> Column:
    """The terminal's size: whole bytes, KB with one decimal, MB with two."""
    x = F.coalesce(col(n), F.lit(0)).cast("double")
    fixed = lambda value, digits, unit: F.concat(F.format_string(f"%.{digits}f", value), F.lit(unit))
    return F.when(x < 1024, fixed(x, 0, " B")).when(x < 1024**2, fixed(x / 1024, 1, " KB")).otherwise(fixed(x / 1024**2, 2, " MB"))


def short_uptime_text(seconds: str | Column) -> Column:
    """The terminal's uptime: its two largest units."""
    s = F.coalesce(col(seconds), F.lit(0)).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def total_time_text(seconds: str | Column) -> Column:
    """Minutes, if there are any, and whole seconds."""
    s = F.coalesce(col(seconds), F.lit(0)).cast("double")
    m = F.floor(s / 60)
    return F.concat(F.when(m > 0, F.concat(m.cast("string"), F.lit("m "))).otherwise(""), F.floor(s % 60).cast("string"), F.lit("s"))


def context_seconds_text(ast_ms: str | Column, rag_ms: str | Column) -> Column:
    """Seconds that finding context took, to two decimals; half a hundredth counts up, as decimals are counted."""
    hundredths = F.floor((col(ast_ms) + col(rag_ms) + 5) / 10)
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("s"))


#: Marks of a log line's colour, first hit first (fixed values).
LOG_COLOURS = (("error", ("[Error", "Exception", "Failed")), ("model", ("[MLX]",)), ("core", ("[Core]",)))


def log_colour(line: str | Column) -> Column:
    """Class of a log line's colour: error, model, core or plain; case counts."""
    out = F.lit("plain")
    for name, marks in reversed(LOG_COLOURS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.coalesce(col(line), F.lit("")).contains(m)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def padded(value: str | Column, width: int, right: bool = False) -> Column:
    """Text filled up to ``width``: at its end, or with ``right`` at its start; longer text stays whole."""
    text = F.coalesce(col(value).cast("string"), F.lit(""))
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text)))
    return F.concat(fill, text) if right else F.concat(text, fill)
