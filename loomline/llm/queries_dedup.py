"""Query op5 over the whole table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dedup
from .common import table


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
#: The same by brute force: shingles are joined, links counted and walked. A whole short text starts with a blank, which no shingle does.
ORACLE_SQL = r"""WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT k, unnest(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [' ' || array_to_string(words, ' ')] ELSE [] END)) AS gram FROM w),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
i AS (SELECT a.k AS a, b.k AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM i JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(k, o) AS (SELECT k, k FROM w UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.o),
c AS (SELECT r.k, min(w.doc_id) AS component_id FROM r JOIN w ON w.k = r.o GROUP BY r.k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, doc_id IS NULL AND component_id IS NULL) AS kept
FROM w JOIN c ON c.k = w.k LEFT JOIN n ON n.k = w.k
"""
ORACLES = {"op5_minhash_near_dedup": ORACLE_SQL}
