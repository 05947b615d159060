"""Benchmark decontamination by winnowing, with DataFrame operations only.

The least hash of every ``window`` consecutive runs of ``gram`` words is a fingerprint. Two texts that share
``window + gram - 1`` words in a row share the whole window of hashes and so its least one: no shared span of that
length is missed. Documents whose fingerprints meet one of the test items are read again: around each run found, spans
of full length are looked up among the items' spans by their very words, so hashes only propose. Items shorter than a
span are spans of their own length, and every run of that many words is a fingerprint.

Texts with equal words count as one on the way: what moves for a text is its 128-bit name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_BROADCAST = 200_000  # rows of matches (a name and a hash) that are sent whole; beyond, texts and matches are shuffled


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered: runs of ASCII letters and digits and of all that isn't ASCII. Null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(ITEM_WORD), F.lit(0))


def _runs(words: Column, k: int, make) -> Column:
    """``make`` of each run of k words, in order; none if there are fewer."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: make(F.slice(words, i, k)))).otherwise(F.array())


def _hashes(words: Column, k: int) -> Column:
    return _runs(words, k, lambda run: F.xxhash64(F.lit(k), run)).cast("array<long>")


def _let(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, however often and wherever it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _minima(hashes: Column, window: int) -> Column:
    """The distinct least hashes of all windows; none if there are fewer hashes than a window has."""
    none = F.array().cast("array<long>")
    least = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.array_min(F.slice(h, i, window))))
    return _let(hashes, lambda h: F.when(F.size(h) >= window, least(h)).otherwise(none))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, gram: int = 5) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``span`` consecutive words of an item, or all of a shorter one; a document's word is hit if it lies in an
    occurrence of any. n_items counts the distinct item ids (as text; a null id counts as an empty one) with occurring windows, items_sha256 is taken of those ids,
    sorted and joined by commas. Null, empty and wordless texts have no words and no hits; items without words are none.
    Repeated rows stay rows. Without items or documents nothing is found. Further columns, whatever their names, are ignored.

    Texts are tokenised where they are read. Only fingerprints that stand in an item are kept, so what is shuffled or
    broadcast grows with the matches. Matches of up to ``MOST_BROADCAST`` rows are sent to the texts, more are joined by shuffles.
    """
    window = span - gram + 1
    asked = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{item_text_col}`")).alias("words")).filter(F.size("words") > 0)
    spans = F.when(F.size("words") >= span, _runs(F.col("words"), span, lambda run: F.array_join(run, " "))).otherwise(F.array(F.array_join("words", " ")))
    asked = written(asked.select("item", F.least(F.size("words"), F.lit(span)).alias("k"), spans.alias("spans"), "words"), "winnow-items")
    lengths = sorted(r["k"] for r in asked.select("k").distinct().collect())  # at most ``span`` rows
    short = [k for k in lengths if k < span]
    owners = asked.select("item", "k", F.explode("spans").alias("span")).distinct()
    # spans that the same items have are one class, named by a sum over its items: sets are never gathered
    classes = written(owners.groupBy("k", "span").agg(_set_name("item").alias("class")), "winnow-spans")
    named = classes.groupBy("class").agg(F.min(F.struct("k", "span")).alias("s")).select("class", "s.*")
    class_items = written(named.join(owners, ["k", "span"]).select("class", "item"), "winnow-classes")

    own = _minima(_hashes(F.col("words"), gram), window)
    marks = F.when(F.col("k") == span, own).otherwise(F.array(F.xxhash64(F.col("k"), "words")))
    fingerprints = written(asked.select(F.explode(marks).alias("mark")).distinct(), "winnow-marks")

    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("name"), words_of(F.col(f"`{text_col}`")).alias("words"))
    every = [_minima(_hashes(F.col("words"), gram), window)] if span in lengths else []
    every += [F.array_distinct(_hashes(F.col("words"), k)) for k in short]
    marks = F.concat(*every) if every else F.array().cast("array<long>")
    rows = written(read.select("doc_id", "name", F.size("words").alias("n_words"), marks.alias("marks")), "winnow-rows")
    matches = written(rows.select("name", F.explode("marks").alias("mark")).join(fingerprints, "mark", "left_semi").distinct(), "winnow-matches")
    few = matches.count() <= MOST_BROADCAST
    found = matches.groupBy("name").agg(F.collect_set("mark").alias("marks"))  # of one text each
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("name"))
    again = texts.join(F.broadcast(found) if few else found, "name")
    again = again.select("name", "marks", words_of(F.col("text")).alias("words"))

    # extend: every span of full length that covers a run found
    def around(k: int, reach: int) -> Column:
        """Starts of the spans, of ``k`` words each, that hold a marked run; ``reach`` is how much longer they are than the run."""
        hashes = _hashes(F.col("words"), k - reach)
        at = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains("marks", h), i + 1)), lambda p: p.isNotNull())
        last = F.size("words") - (k - 1)
        inside = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - reach, F.lit(1)), F.greatest(p, F.lit(1))))))
        return F.transform(F.filter(inside, lambda p: p <= last), lambda p: F.struct(F.lit(k).alias("k"), p.alias("p"), F.array_join(F.slice("words", p, k), " ").alias("span")))

    looked = [around(span, span - gram)] if span in lengths else []
    looked += [around(k, 0) for k in short]
    if looked:
        tried = again.select("name", F.explode(F.concat(*looked)).alias("s")).select("name", "s.*")
        hits = written(tried.join(classes, ["k", "span"]).select("name", "k", "p", "class").distinct(), "winnow-hits")
    else:
        hits = written(rows.select("name", F.lit(0).alias("k"), F.lit(0).alias("p"), F.lit("").alias("class")).limit(0), "winnow-hits")
    covered = F.explode(F.sequence(F.col("p"), F.col("p") + F.col("k") - 1))
    n_hit = hits.select("name", "k", "p").distinct().select("name", covered.alias("at")).distinct().groupBy("name").agg(F.count("*").alias("n_hit"))
    # texts with the same classes share their items: those are joined once per set of classes
    pairs = hits.select("name", "class").distinct()
    sets = written(pairs.groupBy("name").agg(_set_name("class").alias("set")), "winnow-sets")
    first = sets.groupBy("set").agg(F.min("name").alias("name"))
    ids = first.join(pairs, "name").join(class_items, "class").select("set", "item").distinct()
    joined = ids.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    results = written(sets.join(joined, "set").join(n_hit, "name").select("name", "n_hit", "n_items", "items_sha256"), "winnow-results")
    out = rows.drop("marks").join(results, "name", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _set_name(member: str) -> Column:
    """A name of the set of a group's distinct members: their number and two sums of 64-bit hashes, so that partial sums merge."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), member).cast("decimal(20,0)"))
    return F.concat_ws(":", F.count("*"), wide(1), wide(2))


#: The same in DuckDB's SQL, over the views ``documents`` and ``benchmark``.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS span FROM b WHERE len(w) > 0),
t AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS span
  FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k),
h AS (SELECT r, k, p, span FROM t WHERE (k, span) IN (SELECT k, span FROM s)),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h JOIN s USING (k, span) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN i ON i.r = d.r
"""
