"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target of words. A source whose target is r times its size gives floor(r) certain whole copies of
every document; the rest of the target is filled by a fixed-size sample: documents are ranked by their random odds
u/(1-u) over their inclusion odds, and taken in that order until the words fit. The inclusion odds of a document are
f/(1-f) times its tilt, f being the fraction of the source still wanted; f is one number per source and so doesn't
change the order within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, written

SEED = "mix-1"


def random_odds(id_col: str, text_col: str, seed: str) -> Column:
    """u/(1-u) with u from the md5 of seed, id and text: 52 bits, never 0 or 1, the same in each run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return u / (F.lit(1.0) - u)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources by code point, null last.

    Water-filling in closed form: by ascending limit*size/weight a source is capped at limit*size while its share of
    what is left is larger. The window has no key: its rows are the sources, not the documents.
    """
    every = W.partitionBy(F.lit(0))
    nth = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(nth - 1, F.lit(len(weights))).cast("int") + 1)
    by_ratio = every.orderBy("ratio", F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
        .withColumn("first_open", F.min(F.when(~F.col("capped"), F.struct("ratio", "left_words", "left_weight"))).over(every))
        .select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("first_open.left_words") / F.col("first_open.left_weight"))).alias("target"))
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0, bins: int = 2048, seed: str = SEED, carry: bool = False) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    size counts words, 0 for a null, empty or blank text; such documents get the certain copies only. target is in
    words and belongs to the source. copies says how often the mix holds the document (0 to ``limit``), taken is copies
    times size. Longer documents are tilted up by the square root of their size. A null source is a source of its own,
    last in order. Ties in the odds (whole repeated rows) are broken by id, nulls first, and size. With ``carry`` all
    columns of ``docs`` come along in a struct ``row``. An empty table gives no rows.

    Words are summed per source and per bin of the odds first (partial sums before the shuffle). The one bin of each source
    where its target is met is cut into as many again, over its own odds; only ids, odds and sizes of one such part are
    put in exact order in a task. They give the last document taken, and all others compare with it where they are:
    texts move only if they repeat that very row.
    """
    odds = random_odds(id_col, text_col, seed)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), odds.alias("odds"), *([F.struct("*").alias("row")] if carry else []))
    rows = rows.withColumn("odds", F.col("odds") / F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double")))
    rows = rows.withColumn("bin", F.least(F.floor(F.lit(float(bins)) * (F.col("odds") / (F.col("odds") + 1.0))), F.lit(bins - 1)).cast("int"))
    rows = written(rows, "mix")

    hist = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")  # bins per source at most
    targets = source_targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_bin = hist.withColumn("before", before).withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source")))
    reached = F.when((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")), F.struct("bin", "before"))
    cuts = per_bin.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole", "budget")], F.max(reached).alias("cut"))
    cuts = written(cuts.select(F.col("source").alias("cut_source"), "source_size", "target", "whole", "budget", F.col("cut.bin").alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("cut_before")), "mix-cuts")

    at_cut = F.col("source").eqNullSafe(F.col("cut_source"))
    # the bin of the cut is cut once more, evenly over its own odds; equal rows are one with a number of times
    narrow = rows.select("source", "bin", "odds", "id", "size").join(cuts, at_cut & (F.col("bin") == F.col("cut_bin"))).groupBy("cut_source", "odds", "id", "size", "cut_before", "budget").agg(F.count("*").alias("times"))
    narrow = written(narrow, "mix-bin")
    span = narrow.groupBy(F.col("cut_source").alias("s")).agg(F.min("odds").alias("least"), (F.max("odds") - F.min("odds")).alias("width"))
    fine = F.when(F.col("width") > 0, F.least(F.floor(F.lit(float(bins)) * ((F.col("odds") - F.col("least")) / F.col("width"))), F.lit(bins - 1))).otherwise(0).cast("int")
    narrow = narrow.join(span, F.col("cut_source").eqNullSafe(F.col("s"))).withColumn("fine", fine)
    fines = narrow.groupBy("cut_source", "fine", "cut_before", "budget").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
    begun = F.col("cut_before") + F.coalesce(F.sum("words").over(W.partitionBy("cut_source").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fines = fines.withColumn("begun", begun).filter((F.col("begun") <= F.col("budget")) & (F.col("budget") < F.col("begun") + F.col("words")))
    fines = fines.groupBy(F.col("cut_source").alias("f")).agg(F.max(F.struct("fine", "begun")).alias("c")).select("f", F.col("c.fine").alias("cut_fine"), F.col("c.begun").alias("begun"))
    # exact order within one fine bin, over narrow rows: documents are taken up to a last one, of which the mix may hold some of its repeats only
    few = narrow.join(fines, F.col("cut_source").eqNullSafe(F.col("f")) & (F.col("fine") == F.col("cut_fine")))
    order = W.partitionBy("cut_source").orderBy("odds", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = F.sum(F.col("size") * F.col("times")).over(order) - F.col("size") * F.col("times") + F.col("begun")
    fit = F.when(F.col("size") > 0, F.floor((2 * F.col("budget") - 2 * F.col("met") - F.col("size")) / (2 * F.col("size"))) + 1).otherwise(F.col("times"))
    few = few.withColumn("met", met).withColumn("fit", F.greatest(F.lit(0), F.least(F.col("times"), fit)).cast("long")).filter("fit > 0")
    last = few.groupBy("cut_source").agg(F.max(F.struct("odds", "id", "size", "fit")).alias("last"))
    # where nothing of the fine bin fits, the cut is its first odds
    first = narrow.join(fines, F.col("cut_source").eqNullSafe(F.col("f")) & (F.col("fine") == F.col("cut_fine"))).groupBy(F.col("cut_source").alias("f")).agg(F.min("odds").alias("first"))
    ends = first.join(last, F.col("f").eqNullSafe(F.col("cut_source")), "left").select("f", "first", "last")
    cuts = written(cuts.join(ends, F.col("cut_source").eqNullSafe(F.col("f")), "left").drop("f"), "mix-ends")  # a row per source

    joined = rows.join(cuts, at_cut)
    own, end = F.struct("odds", "id", "size"), F.struct("last.odds", "last.id", "last.size")
    in_bin = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    equal = in_bin & F.col("last").isNotNull() & F.coalesce(own.eqNullSafe(end), F.lit(False))
    before_cut = F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)) | (in_bin & F.coalesce(F.when(F.col("last").isNotNull(), own < end).otherwise(F.col("odds") < F.col("first")), F.lit(False)))
    outside = joined.filter(~equal).withColumn("extra", before_cut.cast("long"))
    nth = F.row_number().over(W.partitionBy("source").orderBy("odds"))  # repeats of one row
    inside = joined.filter(equal).withColumn("extra", (nth <= F.col("last.fit")).cast("long"))
    extra = F.when(F.col("size") > 0, F.col("extra")).otherwise(0)  # blank documents don't count towards a target
    out = outside.unionByName(inside).withColumn("copies", F.col("whole") + extra)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


#: The same mix in DuckDB's SQL, over the view ``documents``.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
o AS (SELECT doc_id, source, size, (u / (1.0::DOUBLE - u)) / sqrt(greatest(size, 1)::DOUBLE) AS odds FROM w),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM o GROUP BY source),
a AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
b AS (
  SELECT *,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS left_words
  FROM a),
c AS (SELECT *, cap * left_weight <= weight * left_words AS capped FROM b),
d AS (SELECT arg_min(left_words / left_weight, cap / weight) AS level FROM c WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (SELECT level FROM d) END AS target FROM c),
r AS (
  SELECT o.doc_id, o.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
    sum(o.size) OVER (PARTITION BY o.source ORDER BY o.odds, o.doc_id NULLS FIRST, o.size ROWS UNBOUNDED PRECEDING) - o.size AS met
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN 2 * met + size <= 2 * greatest(0.0::DOUBLE, target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
