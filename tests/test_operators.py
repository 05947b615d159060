import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import rules, text
from loomline.functions.ranking import numbered
from loomline.operators import graph, index, messages, retrieval, telemetry
from loomline.plans import retrieve as plan
from loomline.sources import files, logs, manifest, vectors
from tests.small_project import PROJECT


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_measures(spark):
    assert one(spark, text.units(F.lit("😀a"))) == 3 and one(spark, text.chunk_tokens(F.lit(""))) == 1
    assert one(spark, text.block_tokens(F.lit("abcde"))) == 2 and one(spark, text.fallback_tokens(F.lit("abcdefg"))) == 1
    assert one(spark, text.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, text.resolved(F.lit("/a/b/c.ts"), F.lit("../d/./e"))) == "/a/d/e" and one(spark, text.folded(F.lit("/../x"))) == "/x"
    assert one(spark, text.stem(F.lit("/a/b.d.ts"))) == "b.d" and one(spark, text.stem(F.lit("/a/.env"))) == ".env"


def test_formats(spark):
    for n, want in ((0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (5 << 30, "5 GB"), (1100, "1.07 KB")):
        assert one(spark, rules.bytes_text(F.lit(n))) == want
    for n, want in ((0, "0s"), (59, "59s"), (61, "1m 1s"), (3600, "1h 0s"), (7325, "2h 2m 5s")):
        assert one(spark, rules.uptime_text(F.lit(n))) == want
    assert one(spark, rules.bar(F.lit(5), F.lit(10), 4)) == "██░░" and one(spark, rules.log_level(F.lit("x WARN y"))) == "WARN"


def test_numbered_equals_a_sort(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1.0, 2.0, rng.random() * 9])) for i in range(500)]
    got = numbered(spark.createDataFrame(data, "id int, k double").repartition(7), F.col("k"), F.col("id"), ranges=8).collect()
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.id: r.nth for r in got} == {r[0]: n + 1 for n, r in enumerate(order)}


def test_queue_rules(spark):
    jobs = [("a", "HIGH", 1, 10), ("a", "LOW", 2, 20), ("b", "LOW", 3, 30), ("b", "HIGH", 4, 40), ("c", "LOW", 5, 50), ("c", "LOW", 6, 60)]
    q = index.queued(spark.createDataFrame(jobs, "path string, priority string, seq long, queued_at long"))
    assert {(r.path, r.priority, r.seq) for r in q.collect()} == {("a", "HIGH", 1), ("b", "HIGH", 4), ("c", "LOW", 6)}
    assert [(r.path, r.batch) for r in index.batches(q, 2).orderBy("place").collect()] == [("a", 0), ("b", 0), ("c", 1)]


def test_diff_partitions_the_keys(spark):
    snap = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), ("c", 3.0, 3), ("e", None, 1)], "path string, mtime double, size long")
    man = spark.createDataFrame([("a", 1.0, 1, 1, 1, True), ("b", 2.5, 2, 1, 1, True), ("c", 3.0, 3, 1, 1, False), ("d", 1.0, 1, 1, 1, True), ("e", None, 1, 1, 1, True)], "path string, mtime double, size long, ast_version int, rag_version int, has_chunk boolean")
    assert {r.path: r.status for r in index.manifest_diff(snap, man).collect()} == {"a": "UNCHANGED", "b": "CHANGED", "c": "CHANGED", "d": "DELETED", "e": "UNCHANGED"}


def pack(items, budget):
    room, out = budget, []
    for pos, tokens, score in sorted(items, key=lambda x: (-x[2], x[0])):
        if tokens <= room:
            room -= tokens
            out.append(pos)
    return out


def test_packing(spark):
    rng = random.Random(2)
    groups = {g: [(i, rng.randint(0, 50), float(rng.choice([1, 2, 3]))) for i in range(rng.randint(1, 20))] for g in range(30)} | {99: [(1, 5, 2000.0), (2, 9, 110.0), (3, 3, 50.0)]}
    rows = [(g, p, str(p), t, s) for g, xs in groups.items() for p, t, s in xs]
    for budget in (10, 100):
        got = {}
        for r in retrieval.packed(spark.createDataFrame(rows, "task_id long, pos long, id string, tokens long, score double"), budget).orderBy("nth").collect():
            got.setdefault(r.task_id, []).append(r.pos)
        assert got == {g: pack(xs, budget) for g, xs in groups.items() if pack(xs, budget)}


def trim(tokens, budget):
    kept = list(range(len(tokens)))
    while sum(tokens[i] for i in kept) > budget and len(kept) > 2:
        del kept[1]
    return kept


def test_trimming(spark):
    rng = random.Random(3)
    convs = {c: [rng.randint(0, 9) for _ in range(rng.randint(1, 12))] for c in range(40)}
    rows = [(c, t, "user", "x", n) for c, xs in convs.items() for t, n in enumerate(xs)]
    got = messages.trimmed(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, n long"), 20, F.col("n"))
    kept = {}
    for r in got.orderBy("turn").collect():
        kept.setdefault(r.conv_id, []).append(r.turn)
    assert kept == {c: trim(xs, 20) for c, xs in convs.items()}


def test_task_text_of_parts(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", '[{"type":"image"},{"type":"text","text":""}]'), (2, 0, "user", '[{"type":"text","text":"parts"}]'), (3, 0, "system", "s"), (4, 0, "user", "old"), (4, 1, "user", ""), (5, 0, "user", "[not json")]
    got = {r.conv_id: r.task for r in messages.task_text(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")).collect()}
    assert got == {1: "first", 2: "parts", 3: "", 4: "", 5: "[not json"}


def test_medians_and_threshold(spark):
    for xs, want in (([], 0), ([7], 7), ([1, 2, 3, 4], 3), ([3, 1, 2], 2)):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "ts long, v long")
        assert telemetry.upper_median(df, "v").first().p50 == want
    row = lambda rows: telemetry.calibrated_threshold(spark.createDataFrame(rows, "score double, reasoning string, success int")).first().threshold
    assert row([]) == 0.55 and row([(0.15, "no_think", 0)]) == 0.1 and row([(0.9, "no_think", 0), (0.5, "think", 0)]) == pytest.approx(0.8)


def test_graphs(spark):
    edges = [("A", 0, "B"), ("A", 1, "C"), ("B", 0, "C"), ("D", 0, "E"), ("E", 0, "D"), ("F", 0, "D"), ("G", 0, "G"), ("A", 2, "gone"), ("E", 1, "C")]
    e = spark.createDataFrame(edges, "src string, pos int, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCDEFG"], "node string")
    assert {r.node: r.depth for r in graph.depths(e, nodes).collect()} == {"A": 2, "B": 1, "C": 0, "D": None, "E": None, "F": None, "G": None}
    assert {r.node for r in graph.cyclic_nodes(e, nodes).collect()} == {"D", "E", "G"}
    assert {(r.node, r.steps) for r in graph.reachable(e, nodes.filter("node = 'C'")).collect()} == {("C", 0), ("A", 1), ("B", 1), ("E", 1), ("D", 2), ("F", 3)}
    walked = {r.node: r for r in graph.walked_metrics(e.filter("dst != 'gone'").withColumn("project", F.lit(1)), nodes.withColumn("project", F.lit(1))).collect()}
    assert (walked["A"].depth, walked["A"].cyclic_refs, walked["A"].cyclic_edges) == (1, ["C"], 1)  # a diamond


def project(spark):
    return plan.Project.of(spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(PROJECT.items())], "path string, content string, pos long"))


def test_retrieval_end_to_end(spark):
    p = project(spark)
    assert {(r.src, r.dst) for r in p.edges.collect()} == {("shop/cart.ts", "shop/prices.ts"), ("shop/LineTable.tsx", "shop/cart.ts"), ("shop/LineTable.tsx", "shop/prices.ts")}
    tasks = spark.createDataFrame([(1, "make LineTable faster"), (2, "nothing here"), (3, "addLine fails")], "task_id long, task string")
    found = {}
    for r in plan.lexical(p, tasks).orderBy("nth").collect():
        found.setdefault(r.task_id, []).append(r.file_path)
    assert found[1][0] == "shop/LineTable.tsx" and set(found[1]) == {"shop/LineTable.tsx", "shop/cart.ts", "shop/prices.ts"} and found[3][0] == "shop/cart.ts" and 2 not in found
    ctx = {r.task_id: r for r in plan.contexts(p, tasks, score=retrieval.scorer(), active_path="prices.ts").collect()}
    assert ctx[1].think and "// ACTIVE FILE: prices.ts" in ctx[1].ast_context and "(Full Context)" in ctx[1].ast_context and ctx[1].files[0] == "LineTable.tsx"
    assert ctx[1].ast_context.startswith("// ACTIVE FILE")
    small = {r.task_id: r.tokens for r in plan.contexts(p, tasks, budget=40).collect()}
    assert all(n <= 40 for n in small.values())
    conv = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "make LineTable faster")], "conv_id long, turn long, role string, content string")
    out = plan.answered(p, conv).orderBy("turn").collect()
    assert [r.role for r in out] == ["system", "system", "user"] and "<context>" in out[1].content
    assert p.status().first().files == 3


def test_vector_table(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    assert vectors.open_table(spark, path).count() == 0
    docs = spark.createDataFrame([("a'b.ts", "one two three"), ("c.ts", "four five"), ("d.ts", "")], "path string, content string")
    vectors.with_files(vectors.open_table(spark, path), vectors.embedded(docs, retrieval.embedder())).write.parquet(path)
    table = vectors.open_table(spark, path)
    assert {r.file_path for r in table.collect()} == {"a'b.ts", "c.ts"}
    failed = vectors.embedded(docs, retrieval.embedder(lambda t: 1 / 0))
    assert vectors.with_files(table, failed).count() == 2 and {r.file_path for r in vectors.stale(table, failed).collect()} == {"a'b.ts", "c.ts"}
    assert vectors.without_files(table, docs.filter("path = \"a'b.ts\"")).count() == 1
    tasks = spark.createDataFrame([(1, retrieval.hashed_embedding("four five")), (2, [0.0] * 64)], "task_id long, vector array<double>")
    assert [(r.task_id, r.file_path) for r in plan.search(table, tasks, 1).collect()] == [(1, "c.ts")]


def test_files_and_logs(spark, tmp_path):
    for p in ("src/a.ts", "src/b.tsx", "src/dist/c.ts", "src/distance.ts", "node_modules/d.ts", "src/e.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("let x = 1")
    snap = files.scan(spark, str(tmp_path)).collect()
    assert {r.relative_path for r in snap} == {"src/a.ts", "src/b.tsx", "src/distance.ts"} and all(r.size == 9 and r.mtime > 1e12 for r in snap)
    assert {r.content for r in files.read_sources(spark, str(tmp_path)).collect()} == {"let x = 1"}
    assert files.tree_bytes(spark, str(tmp_path)).first().bytes == 54
    log = tmp_path / "x.log"
    log.write_text("".join(f"line {i}\n\n" for i in range(20)))
    assert [r.line for r in logs.tail(spark, str(log), 3).orderBy("nth").collect()] == ["line 17", "line 18", "line 19"]
    assert logs.tail(spark, str(tmp_path / "none.log")).count() == 0


def test_manifest_versions(spark, tmp_path):
    m = manifest.Manifest(spark, f"{tmp_path}/m")
    assert m.load().count() == 0
    (tmp_path / "old.json").write_text('{"version": 1, "files": {"a.ts": {"mtime": 1.5, "size": 3, "hash": "h", "astVersion": 1, "ragVersion": 1, "astChunk": {"exports": ["x"]}}, "b.ts": 7}}')
    rows = m.load(legacy=f"{tmp_path}/old.json").collect()
    assert [(r.path, r.mtime, r.ast_version) for r in rows] == [("a.ts", 1.5, 1)]
    m.save(m.load().unionByName(m.load().withColumn("path", F.lit("c.ts")).withColumn("ast_chunk", F.lit("{broken"))))
    assert [r.path for r in m.load().collect()] == ["a.ts", "c.ts"]
    parsed = manifest.parsed_chunks(m.load(), "exports array<string>").collect()
    assert parsed[0].chunk.exports == ["x"]
    (tmp_path / "v9.json").write_text('{"version": 9, "files": {}}')
    assert manifest.read_legacy(spark, f"{tmp_path}/v9.json").count() == 0


def test_rows_without_mtime_stay_whole(spark, tmp_path):
    m = manifest.Manifest(spark, f"{tmp_path}/m")
    row = lambda path, mtime, size: (path, mtime, size, "h", 1, 1, None)
    m.save(spark.createDataFrame([row("a.ts", None, 1), row("b.ts", None, 2), row("b.ts", 5.0, 3)], manifest.SCHEMA))
    assert [(r.path, r.mtime, r.size) for r in m.load().collect()] == [("a.ts", None, 1), ("b.ts", 5.0, 3)]


def test_roots_are_plain_text(spark, tmp_path):
    root = tmp_path / "a+b (c) [d].x"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("x")
    for r in (str(root), f"file://{root}/"):
        assert [x.relative_path for x in files.scan(spark, r).collect()] == ["src/a.ts"]


def test_long_paths_are_followed_to_the_end(spark):
    e = spark.createDataFrame([(i, 0, i + 1) for i in range(20)], "src long, pos int, dst long")
    got = {r.node: r.steps for r in graph.reachable(e, spark.createDataFrame([(20,)], "node long")).collect()}
    assert got == {i: 20 - i for i in range(21)}


def rounds_of(monkeypatch):
    """Tags of the tables that graph rounds write."""
    tags, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag, *a: tags.append(tag) or plain(df, tag, *a))
    return tags


def test_chains_take_logarithmic_rounds(spark, monkeypatch):
    n = 10_000
    ids = spark.range(n + 1)
    e = ids.filter("id > 0").select(F.col("id").alias("src"), F.lit(0).alias("pos"), (F.col("id") - 1).alias("dst"))
    nodes = ids.select(F.col("id").alias("node"))
    tags = rounds_of(monkeypatch)
    assert graph.depths(e, nodes).filter("depth != node").isEmpty() and tags.count("depth-state") + tags.count("depth-jumps") <= 40
    del tags[:]
    got = graph.reachable(e, nodes.filter("node = 0"))
    assert got.count() == n + 1 and got.filter("steps != node").isEmpty() and tags.count("spread") + tags.count("jumps") // 2 <= 40


def random_graphs(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        size = rng.randint(2, 14)
        yield size, {(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(1, size + 4))}


def reach_of(edges, a):
    seen, todo = set(), [a]
    while todo:
        here = todo.pop()
        for d in [d for s, d in edges if s == here]:
            if d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("often", [1, 3])
def test_graphs_at_random(spark, often):
    """Many small graphs side by side: depths, cycles and steps by brute force, with pointer jumping early and late."""
    all_nodes, all_edges, start = [], [], 0
    for size, edges in random_graphs(12, often):
        all_nodes += range(start, start + size)
        all_edges += [(start + a, start + b) for a, b in edges]
        start += size
    all_edges += [(start + i, start + i + 1) for i in range(20)] + [(start + 25, start + 3), (start + 25, start + 12), (start + 26, start + 25)]  # runs that meet
    all_nodes += range(start, start + 27)
    e = spark.createDataFrame([(a, 0, b) for a, b in all_edges], "src long, pos int, dst long")
    nodes = spark.createDataFrame([(x,) for x in all_nodes], "node long")
    reach = {a: reach_of(all_edges, a) for a in all_nodes}
    on = {a for a in all_nodes if a in reach[a]}
    endless = {a for a in all_nodes if a in on or reach[a] & on}
    want = {a: None if a in endless else longest(all_edges, a) for a in all_nodes}
    assert {r.node: r.depth for r in graph.depths(e, nodes, often=often).collect()} == want
    pairs = e.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    least = {a: min([a, *(b for b in all_nodes if a in reach[b])]) for a in all_nodes}
    assert {r.node: r.value for r in graph.spread(nodes.select("node", F.col("node").alias("value")), pairs, often=often).collect()} == least
    if often == 1:
        scc = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in on}
        found = graph.components(e, nodes)
        assert {r.node: r.component for r in found.collect()} == scc
        refs = {a: len({d for s, d in all_edges if s == a and a in reach[d] | ({d} if d == a else set())}) for a in on}
        assert {r.node: r.cyclic_refs for r in graph.cyclic_refs(e, found).collect()} == refs
        assert {r.node for r in graph.cyclic_nodes(e, nodes).collect()} == on


def test_nodes_between_cycles_are_on_none(spark):
    e = spark.createDataFrame([(a, 0, b) for a, b in ("ab", "ba", "bc", "cd", "de", "ed")], "src string, pos int, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert {(r.node, r.component) for r in graph.components(e, nodes).collect()} == {("a", "a"), ("b", "a"), ("d", "d"), ("e", "d")}


def test_depths_follow_changes_only(spark):
    """New and lost edges, one that changes no depth, a new cycle: its edges count old depths, and nodes before it follow."""
    e = lambda *xs: spark.createDataFrame([(a, 0, b) for a, b in xs], "src long, pos int, dst long")
    base = [(i, i - 1) for i in range(1, 8)]
    old = spark.createDataFrame([(i, i) for i in range(8)] + [(9, None)], "node long, depth long")
    seeds = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node long")
    got = lambda *a, **k: {r.node: r.depth for r in graph.maintained(*a, **k).collect()}
    assert got(e(*base, (5, 1)), old, seeds(5)) == {}
    assert got(e(*base[:4], *base[5:]), old, seeds(5)) == {5: 0, 6: 1, 7: 2}
    assert got(e(*base, (9, 7)), old, seeds(9)) == {9: 8}
    assert got(e(*base, (9, 99)), old, seeds(9)) == {9: 0}
    cyclic = e(*base, (2, 4))  # 2 -> 4 -> 3 -> 2
    assert graph.maintained(cyclic, old, seeds(2)) is None
    held = graph.components(cyclic, old.select("node"))
    assert got(cyclic, old, seeds(2), held) == {2: 5}  # 4 is being walked: its old depth counts, and 3 counts that of 2


def test_updates_that_close_a_cycle(spark):
    name = lambda i: f"/p/f{i}.ts"
    edges = [(3, 2), (2, 1), (1, 3), (4, 3), (5, 0)]  # 1 -> 3 is new
    imports = spark.createDataFrame([(name(s), 0, f"./f{d}") for s, d in edges], "file_path string, pos int, specifier string")
    files = spark.createDataFrame([(name(i),) for i in range(6)], "path string")
    before = graph.graph_edges(imports.filter(F.col("file_path") != name(1)), files, files)
    nodes = spark.createDataFrame([(name(i), d, 1, 0, 1) for i, d in enumerate([0, 0, 1, 2, 3, 1])], "path string, depth long, cross_file_imports long, cyclic_refs int, exports int")
    got = graph.updated(nodes, before, imports, files, spark.createDataFrame([(name(1),)], "path string"))
    assert {r.path: r.depth for r in got.nodes.collect()} == {name(i): d for i, d in enumerate([0, 3, 1, 2, 3, 1])}


def longest(edges, node):
    return max((1 + longest(edges, d) for s, d in edges if s == node), default=0)


def test_updates_touch_what_depends_on_a_change(spark):
    rng = random.Random(4)
    name = lambda i: f"/p/f{i}.ts"
    old = sorted({(i, rng.randrange(i)) for i in range(1, 25) for _ in range(2)})
    said = [(s, d) for s, d in old if s not in (5, 7)] + [(7, 0)]  # file 5 goes, though others still import it; 7 changes
    new = [(s, d) for s, d in said if d != 5]
    table = lambda es: spark.createDataFrame([(name(s), k, f"./f{d}") for k, (s, d) in enumerate(es)], "file_path string, pos int, specifier string")
    paths = lambda skip=(): spark.createDataFrame([(name(i),) for i in range(25) if i not in skip], "path string")
    before = graph.graph_edges(table(old), paths(), paths())
    nodes = spark.createDataFrame([(name(i), longest(old, i), sum(s == i for s, _ in old), 1, 2) for i in range(25) if i != 5], "path string, depth long, cross_file_imports long, cyclic_refs int, exports int")
    got = graph.updated(nodes, before, table(said), paths((5,)), spark.createDataFrame([(name(5),), (name(7),)], "path string"))
    rows = {r.path: r for r in got.nodes.collect()}
    assert {(r.src, r.dst) for r in got.edges.collect()} == {(name(s), name(d)) for s, d in new}
    touched = {7} | {s for s, d in said if d in (5, 7)}
    while more := {s for s, d in new if d in touched} - touched:
        touched |= more
    for i in set(range(25)) - {5}:
        assert rows[name(i)].depth == longest(new, i) and rows[name(i)].cyclic_refs == (i not in touched), i
        assert rows[name(i)].cross_file_imports == sum(s == i for s, _ in new)
    s = got.summary.first()
    assert s.max_depth == max(longest(new, i) for i in range(25) if i != 5) and s.symbols == 48


def test_edges_are_replaced_and_files_leave(spark):
    e = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a")], "src string, pos int, dst string")
    some = spark.createDataFrame([("a",)], "path string")
    new = spark.createDataFrame([("a", 0, "c")], e.schema)
    assert sorted((r.src, r.dst) for r in graph.replaced_edges(e, some, new).collect()) == [("a", "c"), ("b", "c"), ("c", "a")]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    left, lines = graph.without_file(nodes, e, some)
    assert {r.path for r in left.collect()} == {"b", "c"} and {(r.src, r.dst) for r in lines.collect()} == {("b", "c"), ("c", "a")}
    chunks = spark.createDataFrame([("x", 1, "old"), ("y", 2, "y"), ("x", 3, "new")], "path string, seq long, body string")
    assert {(r.path, r.body, r.place) for r in graph.latest_nodes(chunks).collect()} == {("x", "new", 1), ("y", "y", 2)}


def recursive_walk(edges, start):
    """The same order by recursion: targets are visited last to first, each by the depth of its parent."""
    seen, again, deepest = set(), [], 0

    def visit(node, d):
        nonlocal deepest
        if node in seen:
            again.append(node)
            return
        seen.add(node)
        deepest = max(deepest, d)
        for t in reversed(edges.get(node, [])):
            visit(t, d + 1)

    visit(start, 0)
    return deepest, again


def test_walks_on_random_graphs(spark):
    rng = random.Random(8)
    graphs = {p: {n: [rng.randrange(8) for _ in range(rng.randint(0, 3))] for n in range(8)} for p in range(12)}
    e = spark.createDataFrame([(p, s, k, d) for p, g in graphs.items() for s, ds in g.items() for k, d in enumerate(ds)], "project long, src long, pos int, dst long")
    nodes = spark.createDataFrame([(p, n) for p in graphs for n in range(8)], "project long, node long")
    for r in graph.walked_metrics(e, nodes).collect():
        depth, again = recursive_walk(graphs[r.project], r.node)
        assert (r.depth, r.cyclic_refs, r.cyclic_edges) == (depth, list(dict.fromkeys(again)), len(again))


def test_jobs_and_logs(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "CHANGED"), ("b", "DELETED"), ("c", "NEW")], "path string, reason string")
    kept, todo = index.applied(jobs, spark.createDataFrame([("a",), ("b",), ("z",)], "path string"), spark.createDataFrame([("a",), ("b",)], "path string"))
    assert {r.path for r in kept.collect()} == {"a", "z"} and {r.path for r in todo.collect()} == {"a"}
    for i in range(2):
        files.append_json(spark.createDataFrame([(i,)], "n long"), f"{tmp_path}/log")
    assert sorted(r.n for r in spark.read.json(f"{tmp_path}/log").collect()) == [0, 1]


def test_budget_contexts(spark):
    rows = [(1, 0, "a", 5, 1.0, 0), (1, 1, "b", 9, 9.0, 1), (1, 2, "c", 4, 2.0, 0), (1, 3, "d", 2, 1.0, 1), (2, 0, "e", 1, 1.0, 1)]
    taken = retrieval.packed(spark.createDataFrame(rows, "task_id long, pos long, id string, tokens long, score double, tier int"), 12)
    texts = spark.createDataFrame([(r[0], r[2], r[2].upper()) for r in rows], "task_id long, id string, text string")
    got = {r.task_id: tuple(r)[1:] for r in retrieval.budget_contexts(taken, texts).collect()}
    assert got == {1: ("C\n\nA", "D", 9, 2), 2: ("", "E", 0, 1)}


def test_embeddings_word_by_word():
    import zlib

    text = "One two two three"
    want = [0.0] * 64
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        want[h % 64] += 1 if h >= 1 << 31 else -1
    size = sum(x * x for x in want) ** 0.5
    assert retrieval.hashed_embedding(text) == pytest.approx([x / size for x in want]) and not any(retrieval.hashed_embedding(" "))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from loomline.sources import scratch

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *a: None), getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(ValueError):
        scratch.shared_dir(fake)
    path = scratch.scratch_path(spark, "t")
    spark.range(1).write.parquet(path)
    assert spark.sparkContext.applicationId in path and spark.read.parquet(path).count() == 1


@pytest.mark.parametrize("first", [1, 3, 100])
def test_few_files_give_the_best_ones(spark, first):
    """The same as scoring every file, whatever the first ones are: ties, tasks that few files meet, tasks that none meets."""
    rng = random.Random(first)
    words = ["alpha", "beta", "gamma", "delta", "x", "get", "Loader", "parse_all", "n" * 60, "é"]
    docs = [(i, f"/s/{i % 7}/file{i}.ts", [("function", rng.choices(words, k=rng.choice([0, 1, 5, 40]))), ("component", []), ("type", rng.choices(words, k=2)), ("file", [f"file{i}"])]) for i in range(30)]
    tasks = spark.createDataFrame([(1, "Alpha and BETA"), (2, "loaders of gammadelta"), (3, "file7 only"), (4, "nothing"), (5, "n" * 61), (6, "N" * 59), (7, ""), (8, None)], "task_id long, task string")
    files = spark.createDataFrame(docs, "pos long, file_path string, symbols array<struct<kind:string,names:array<string>>>")
    each = files.select("pos", "file_path", F.explode("symbols").alias("s")).select("pos", "file_path", "s.kind", F.explode("s.names").alias("name"))
    want = retrieval.top_files(retrieval.task_scores(tasks, each)).collect()
    got = retrieval.top_scored(tasks, retrieval.symbol_index(files), first=first, more=3)
    assert sorted(got.select("task_id", "file_path", "pos", "score", "rank").collect()) == sorted((r.task_id, r.file_path, r.pos, r.score, r.rank) for r in want) and len(want) > 10
