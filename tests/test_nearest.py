import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions.ranking import trailing
from loomline.operators import nearest as module
from loomline.operators import retrieval
from loomline.operators.nearest import nearest

SCHEMA = "vec_id long, embedding array<float>, distance string"  # a further column with a clashing name


def brute(rows, queries, k):
    out = set()
    for q, v in queries.items():
        d = sorted((round(float(((np.asarray(x, np.float64) - v) ** 2).sum()), 6), i) for i, x in rows)
        out |= {(q, rank + 1, i, dist) for rank, (dist, i) in enumerate(d[:k])}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 6
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.4).astype(np.float32)
    x[100:400] = x[7]  # a third is one vector
    return list(enumerate(x.tolist()))


def test_batch_search_equals_brute_force(spark, clustered):
    """Small blocks, so that a cell, a hot one too, is many pairs of blocks; ties go by id."""
    df = spark.createDataFrame([(i, v, "x") for i, v in clustered], SCHEMA)
    few = df.filter("vec_id % 20 = 0")
    got = nearest(df, few, 6, pivots=24, block=64, asked=8).collect()
    want = brute(clustered, {i: np.asarray(v, np.float64) for i, v in clustered if i % 20 == 0}, 6)
    assert {(r.query_id, r["rank"], r.id) for r in got} == {w[:3] for w in want}
    at = {w[:3]: w[3] for w in want}
    assert all(abs(r.distance - at[r.query_id, r["rank"], r.id]) <= 1e-6 for r in got)


def test_pivots_rule_cells_out(spark, clustered):
    x = np.array([v for _, v in clustered])
    points = np.unique(x[:40], axis=0)
    q = spark.createDataFrame([(i, v) for i, v in clustered[:90:9]], "query long, v array<double>")
    placed = module._assigned(spark.createDataFrame(clustered, "id long, v array<double>"), points).toPandas()
    cells = placed.groupby("cell").agg(far=("far", "max"), near=("far", lambda f: sorted(f)[:3])).reset_index()
    met = module._asked(q, points, cells, 3, 0.0).count()
    assert 10 <= met < 10 * len(cells) / 3
    assert {r.query for r in module._asked(q, points, cells, 3, 0.0).collect()} == {i for i, _ in clustered[:90:9]}


def test_odd_rows_of_a_batch_search(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, None, "a"), (4, [float("nan"), 1.0], "a"), (5, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (6, [1e9, 0.0], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.query_id, r["rank"], r.id, r.distance) for r in nearest(df, df, 3).orderBy("query_id", "rank").collect()] == [(2, 1, 2, 0.0), (2, 2, 2, 0.0), (2, 3, 1, 1.0), (6, 1, 6, 0.0), (6, 2, 2, (1e9 - 1) ** 2), (6, 3, 2, (1e9 - 1) ** 2)]
    assert nearest(df.limit(0), df, 3).count() == 0
    assert nearest(df, df.limit(0), 3).columns == ["query_id", "rank", "id", "distance"]
    assert nearest(df, df.limit(0), 3).count() == 0
    assert nearest(df, df.filter("vec_id = 2"), 99).count() == 4  # fewer rows than asked for


def test_batch_search_has_no_nested_loop(spark, clustered):
    df = spark.createDataFrame([(i, v, "x") for i, v in clustered], SCHEMA)
    plan = nearest(df, df, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("key", [None, "k"])
def test_trailing_over_blocks_equals_a_window(spark, key):
    """Blocks of 10 rows and windows of 7; most rows have one key, and keys may be null."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000)) for i in range(137)]
    df = spark.createDataFrame(rows, "id long, k string, x long")
    out = trailing(df, 7, {"s": F.sum("x"), "n": F.count("*")}, [F.col("id")], None if key is None else F.col(key), block=10)
    want = {i: [x for j, c, x in rows if j <= i and (key is None or c == k)][-7:] for i, k, _ in rows}
    assert {(r.id, r.k, r.x, r.s, r.n) for r in out.collect()} == {(i, k, x, sum(want[i]), len(want[i])) for i, k, x in rows}
    assert out.columns == ["id", "k", "x", "s", "n"]
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1
    assert trailing(df.limit(0), 7, {"s": F.sum("x")}, [F.col("id")]).count() == 0


def plain_bm25(task, text, texts, most=512):
    import re

    words = lambda x: [w.lower() for w in re.findall("[A-Za-z0-9_]+", x or "")]
    every, q, t = [words(x) for x in texts], words(task), words(text)
    while len(q) + len(t) > most:
        (q if len(q) > len(t) else t).pop()
    n, mean, total = len(every), sum(map(len, every)) / len(every), 0.0
    for w in set(q):
        f, tf = sum(w in x for x in every), t.count(w)
        total += math.log(1 + (n - f + 0.5) / (f + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return total


def test_bm25_equals_its_definition(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "_x", "WORD"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (5, 12, 30, 600, 700, 0)] + [None]
    tasks = [(1, "w1 w2 w2 word nowhere"), (2, " ".join(rng.choices(words, k=300))), (3, None), (4, " ".join(rng.choices(words, k=900)))]
    corpus = retrieval.Corpus.of(spark.createDataFrame([(x, "n") for x in texts], "text string, n string"))
    rows = [(t, p, x) for t, _ in tasks for p, x in enumerate(texts)]
    c = spark.createDataFrame([*rows, rows[0], (9, 0, "w1")], "task_id long, pos long, text string").withColumn("score", F.lit("clash"))
    got = {(r.task_id, r.pos): r.score for r in retrieval.bm25(c, spark.createDataFrame(tasks, "task_id long, task string"), corpus).collect()}
    assert set(got) == {(t, p) for t, p, _ in rows} | {(9, 0)}
    assert got[9, 0] == 0
    for t, p, x in rows:
        assert got[t, p] == pytest.approx(plain_bm25(dict(tasks)[t], x, texts), abs=2e-9)


def test_bm25_without_a_corpus(spark):
    corpus = retrieval.Corpus.of(spark.createDataFrame([], "text string"))
    tasks = spark.createDataFrame([(1, "a b")], "task_id long, task string")
    c = spark.createDataFrame([(1, 0, "a")], "task_id long, pos long, text string")
    assert [tuple(r) for r in retrieval.bm25(c, tasks, corpus).collect()] == [(1, 0, 0.0)]
    plan = retrieval.bm25(c, tasks, corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
