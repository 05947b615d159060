"""What goes through the driver or one task must not grow with the input: plans and steps that did."""

import random

from loomline.operators import graph, retrieval
from loomline.plans import catalog

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_are_resolved_without_broadcasts(spark):
    for name in ("resolve_imports", "potential_importers"):
        got = catalog.QUERIES[name](spark, SF)
        assert got.collect()
        assert "Broadcast" not in plan_of(got), name


def test_index_jobs_hold_no_broadcast_tables(spark):
    for name in ("index_jobs", "manifest_diff", "vector_upsert", "vector_delete"):
        got = catalog.QUERIES[name](spark, SF)
        assert got.collect()
        assert "Broadcast" not in plan_of(got), name


def test_a_batch_of_jobs_does_not_stack_its_sorts_in_one_stage(spark):
    got = catalog.QUERIES["index_jobs"](spark, SF)
    assert plan_of(got).count("HashJoin") + plan_of(got).count("SortMergeJoin") <= 8  # it was a chain of 27


def test_task_scores_are_products_of_small_groups(spark, monkeypatch):
    """Files at several places, repeated, long and unknown names; groups of few files and tasks. No row is made for each name that a file and a task share."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "get", "x", "al", "tool" * 15, "tool" * 15 + "x", "café", "zz"]
    tasks = [(f"t{i}", " ".join(rng.choices(words, k=4)) if i else None) for i in range(40)]
    symbols = [(rng.randrange(3) + f, f"/f{f}" if f else None, rng.choice(["function", "type", "file", "other"]), rng.choice(words)) for f in range(30) for _ in range(rng.randrange(6))]
    want = {}
    for task, says in tasks:
        for pos, file, kind, name in symbols:
            if says and len(name) >= 2 and name.lower() not in retrieval.GENERIC and name.lower() in says.lower():
                first, score = want.get((task, file), (pos, None))
                weight = retrieval.WEIGHTS.get(kind)
                want[task, file] = (min(first, pos), score if weight is None else (score or 0) + weight)
    for name, size in (("GROUP_NAMES", 10), ("GROUP_FILES", 5), ("GROUP_TASKS", 9)):
        monkeypatch.setattr(retrieval, name, size)
    t, s = spark.createDataFrame(tasks, "task_id string, task string"), spark.createDataFrame(symbols, "pos long, file_path string, kind string, name string")
    got = retrieval.task_scores(t, s)
    assert sorted((r["task_id"], str(r["file_path"]), r["pos"], str(r["score"])) for r in got.collect()) == sorted((a, str(b), p, str(x)) for (a, b), (p, x) in want.items())
    assert "FlatMapCoGroupsInArrow" in plan_of(got) and "Join" not in plan_of(got)
    best = lambda df: sorted(map(str, retrieval.top_files(df, 2).select("task_id", "file_path", "pos", "score", "rank").collect()))
    assert best(retrieval.task_scores(t, s, k=2)) == best(got)


def test_rounds_over_a_graph_broadcast_nothing(spark, monkeypatch):
    plans, put = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, *more, **named: (plans.append(plan_of(df)), put(df, *more, **named))[1])
    edges = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 1, 0), (3, 0, 2)], "src long, pos int, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    old = graph.depths(edges, nodes)
    assert sorted(tuple(r) for r in old.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    new = graph.maintained(edges.filter("src != 2 OR dst != 1"), old, nodes.filter("node = 2"))
    assert sorted(tuple(r) for r in new.collect()) == [(2, 1), (3, 2)]
    assert {r["node"] for r in graph.reachable(edges, nodes.filter("node = 1")).collect()} == {1, 2, 3}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
