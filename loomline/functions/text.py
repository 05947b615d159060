"""Text measures and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(text: str | Column) -> Column:
    """Length in UTF-16 units, the measure that token estimates count in; code points beyond the basic plane are two."""
    return F.expr("1") * (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("long")


def round_half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity, unlike Spark's round, which takes them away from zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def chunk_tokens(text: str | Column) -> Column:
    """Budget estimate: a quarter of the units, rounded down, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(units(text) / 4).cast("long"))


def block_tokens(text: str | Column) -> Column:
    """Message-block estimate: a quarter of the units, rounded up."""
    return F.ceil(units(text) / 4).cast("long")


def fallback_tokens(text: str | Column) -> Column:
    """Counter without a tokenizer: a quarter of the units, cut."""
    return F.floor(units(text) / 4).cast("long")


def message_text(role: str | Column, content: str | Column) -> Column:
    """What a message counts as: role, newline, content, newline."""
    return F.concat(F.coalesce(col(role), F.lit("")), F.lit("\n"), F.coalesce(col(content), F.lit("")), F.lit("\n"))


def truncated_body(body: str | Column, most: int = 250) -> Column:
    """A declaration's body cut to ``most`` characters; braces that the cut leaves open are closed behind a mark."""
    cut = F.substring(col(body), 1, most)
    count = lambda c: F.length(F.regexp_replace(cut, f"[^{c}]", ""))
    left_open = count("{") - count("}")
    tail = F.when(left_open > 0, F.concat(F.lit(" /* … */ "), F.repeat(F.lit("}"), left_open))).otherwise(F.lit(" /* … */"))
    return F.when(F.length(col(body)) <= most, col(body)).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), tail))


def project_id(path: str | Column) -> Column:
    return F.substring(F.sha2(col(path).cast("binary"), 256), 1, 8)


def source_hash(source: str | Column) -> Column:
    return F.sha1(col(source).cast("binary"))


def short_hash(source: str | Column) -> Column:
    return F.substring(F.sha2(col(source).cast("binary"), 256), 1, 10)


def base_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def stem(path: str | Column) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def dir_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def folded(path: str | Column) -> Column:
    """Path with ``.`` and empty parts dropped and ``..`` taking back the part before it."""
    parts = F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def resolved(from_file: str | Column, specifier: str | Column) -> Column:
    """A relative specifier against the folder of the file that names it."""
    return folded(F.concat(dir_name(from_file), F.lit("/"), col(specifier)))


def served_path(url: str | Column) -> Column:
    """File that a dashboard URL names: no query string, no leading slash, the index page for the root."""
    path = F.split(col(url), r"\?", 2)[0]
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(path == "/", F.lit("index.html")).otherwise(F.regexp_replace(path, "^/", ""))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


#: Patterns that find a cursor line and file paths in system messages (fixed values, in the order they are tried).
CURSOR_PATTERNS = (r"(?i)cursor position:? line (\d+)", r"(?i)line (\d+), column")
FILE_PATTERNS = (r"""(?i)<file_content[^>]*path=["']?([^"'\s>]+)["']?""", r"(?i)# ([^\n]+\.(ts|tsx|js|jsx|py|rs|go|md))")
ACTIVE_PATTERNS = (r"(?i)active file:? ([^\s]+)", FILE_PATTERNS[0])


def cursor_line(text: str | Column) -> Column:
    return F.coalesce(*[_first(col(text), p) for p in CURSOR_PATTERNS]).cast("int")


def file_path_in(text: str | Column) -> Column:
    return F.coalesce(*[_first(col(text), p) for p in FILE_PATTERNS])


def active_path_in(text: str | Column) -> Column:
    return F.coalesce(*[_first(col(text), p) for p in ACTIVE_PATTERNS])


def compacted_file(content: str | Column, cursor: str | Column, small: int = 150, around: int = 60, head: int = 80, tail: int = 50) -> Column:
    """A long file cut to the lines around the cursor, or to its head and tail without one; what is left out is counted."""
    lines, at = F.split(col(content), "\n", -1), col(cursor)
    n = F.size(lines)
    start, end = F.greatest(F.lit(0), at - around), F.least(n, at + around)
    mark = lambda k: F.array(F.concat(F.lit("// ... ("), k.cast("string"), F.lit(" lines omitted)")))
    window = F.concat(mark(start), F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), mark(n - end))
    ends = F.concat(F.slice(lines, 1, head), mark(n - head - tail), F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), tail))
    return F.when(n <= small, col(content)).otherwise(F.array_join(F.when(at > 0, window).otherwise(ends), "\n"))


#: Words that mark a useful line of an environment block (fixed values).
USEFUL = ("active", "current", "file", "os:", "cwd", "directory", "cursor", "line ")


def compacted_environment(content: str | Column, most: int = 20) -> Column:
    """The first ``most`` useful lines in environment tags; null if there is none."""
    useful = F.filter(F.split(col(content), "\n", -1), lambda line: _any_of(F.lower(line), USEFUL))
    return F.when(F.size(useful) > 0, F.concat(F.lit("<environment>\n"), F.array_join(F.slice(useful, 1, most), "\n"), F.lit("\n</environment>")))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out
