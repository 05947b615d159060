"""Import graphs: resolving specifiers, edges, reachability, depth, cycles and summaries.

Both sides of a join grow with the graph, and short paths shrink so well in a shuffle that Spark would gather millions of them on the
driver to broadcast them, once a round. So all joins are hinted to be merged: nothing of the graph goes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import resolved
from ..sources.scratch import ship, written

#: Suffixes tried for a relative specifier, in this order (fixed values).
SUFFIXES = (".ts", ".tsx", "/index.ts", "/index.tsx", ".d.ts")


def import_candidates(imports: DataFrame) -> DataFrame:
    """(file_path, pos, nth, candidate) of the relative imports (file_path, pos, specifier): one path per suffix, which isn't added twice."""
    base = imports.filter(F.col("specifier").startswith(".")).withColumn("base", resolved("file_path", "specifier"))
    tried = F.array(*[F.when(F.col("base").endswith(s), F.col("base")).otherwise(F.concat("base", F.lit(s))) for s in SUFFIXES])
    return base.select("file_path", "pos", F.posexplode(tried).alias("nth", "candidate"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, pos, dst): the first candidate of each import that is a file."""
    hit = import_candidates(imports).hint("merge").join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy("file_path", "pos").agg(F.min_by("candidate", "nth").alias("dst")).select(F.col("file_path").alias("src"), "pos", "dst")


def graph_edges(imports: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to files that are nodes; repeated imports stay repeated edges."""
    return resolved_imports(imports, files).hint("merge").join(nodes.select(F.col("path").alias("dst")).distinct(), "dst").select("src", "pos", "dst")


def cross_imports(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("cross_file_imports"))


def potential_importers(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, importer): files with an import that could mean a target, whether or not it exists."""
    return import_candidates(imports).hint("merge").join(targets.select(F.col("path").alias("candidate")), "candidate").select(F.col("candidate").alias("path"), F.col("file_path").alias("importer")).distinct()


def spread(start: DataFrame, pairs: DataFrame, step: int = 0, often: int = 8) -> DataFrame:
    """(node, value): the least value that reaches each node from ``start`` (node, value) along ``pairs`` (node, next), ``step`` more for each pair.

    Every round sends the values that have just improved one pair further. Each ``often`` rounds, runs of nodes with one way
    on are crossed by pointer jumping: jumps of 1, 2, 4, ... pairs are made and followed, so that rounds grow with the
    logarithm of such a run. A round is one written table, which cuts the lineage.
    """
    further = lambda far: F.col("value") + step * far if step else F.col("value")  # noqa: E731  values may be of any kind that has an order
    known = written(start.groupBy("node").agg(F.min("value").alias("value")).withColumn("fresh", F.lit(True)), "spread")
    jumps_of = None
    for n in count(1):
        new = known.filter("fresh")
        if new.isEmpty():
            return known.select("node", "value")
        known = written(_improved(known.withColumn("fresh", F.lit(False)), new.hint("merge").join(pairs, "node").select(F.col("next").alias("node"), further(F.lit(1)).alias("value"))), "spread")
        if n % often:
            continue
        if jumps_of is None:
            single = pairs.groupBy("node").agg(F.min("next").alias("to"), F.max("next").alias("most")).filter("to = most AND to != node")
            jumps_of = written(single.select("node", "to", F.lit(1).cast("long").alias("far")), "jumps")
        jumps, left = jumps_of, jumps_of.count().bit_length()
        if known.filter("fresh").hint("merge").join(jumps, "node", "left_semi").isEmpty():
            continue
        while left and not jumps.isEmpty():
            known = written(_improved(known, known.hint("merge").join(jumps, "node").select(F.col("to").alias("node"), further(F.col("far")).alias("value"))), "spread")
            then = jumps.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("far").alias("more"))
            jumps, left = written(jumps.hint("merge").join(then, "to").select("node", F.col("end").alias("to"), (F.col("far") + F.col("more")).alias("far")), "jumps"), left - 1


def _improved(known: DataFrame, sent: DataFrame) -> DataFrame:
    """Known values (node, value, fresh) with the lesser ones that were sent; those are fresh."""
    least = sent.groupBy("node").agg(F.min("value").alias("sent"))
    better = F.coalesce(F.col("sent") < F.col("value"), F.col("sent").isNotNull())
    return known.hint("merge").join(least, "node", "full").select("node", F.when(better, F.col("sent")).otherwise(F.col("value")).alias("value"), (better | F.coalesce("fresh", F.lit(False))).alias("fresh"))


def reachable(edges: DataFrame, seeds: DataFrame, reverse: bool = True) -> DataFrame:
    """(node, steps): all nodes that reach the seeds (or, forwards, are reached), seeds included, with the least number of steps."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    pairs = written(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "pairs")
    found = spread(seeds.select("node").distinct().withColumn("value", F.lit(0).cast("long")), pairs, 1)
    return found.select("node", F.col("value").cast("int").alias("steps"))


def depths(edges: DataFrame, nodes: DataFrame, most: int | None = None, known: DataFrame | None = None, often: int = 8) -> DataFrame:
    """(node, depth): length of the longest path from each node; nodes on or before a cycle have null (or ``most``, if given).

    ``known``: (node, depth) of nodes outside ``nodes``, which keep their depth; other targets aren't nodes and don't count.
    A node is done when all its targets are; every round takes the targets that have just been done off the counts of
    those before them, and rewrites only what is still open. Every ``often`` rounds, where many open nodes have one open
    target, those are taken out by pointer jumping (``_contracted``) and given their depth at the end: rounds grow with the logarithm of such runs.
    """
    inside = nodes.select("node").distinct()
    pairs = edges.select("src", "dst").distinct().hint("merge").join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
    own = written(pairs.hint("merge").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("w")), "depth-edges")
    state = inside.withColumn("least", F.lit(0).cast("long"))
    if known is not None:
        outer = known.hint("merge").join(inside, "node", "left_anti").select(F.col("node").alias("dst"), (F.col("depth") + 1).cast("long").alias("d"))
        floor = pairs.hint("merge").join(outer, "dst").groupBy(F.col("src").alias("node")).agg(F.max("d").alias("d"))
        state = inside.hint("merge").join(floor, "node", "left").select("node", F.coalesce("d", F.lit(0)).cast("long").alias("least"))
    state, out, aside = _opened(state, own), None, []
    for n in count(1):
        done, rest = state.filter("open = 0").select("node", F.col("least").alias("depth")), state.filter("open > 0")
        if done.isEmpty():
            break
        out = done if out is None else out.unionByName(done)
        off = own.hint("merge").join(done.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max(F.col("depth") + F.col("w")).alias("d"))
        state = written(rest.hint("merge").join(off, "node", "left").select("node", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("least", F.coalesce("d", F.lit(0))).alias("least")), "depth-state")
        if n % often == 0:
            out = written(out, "depths")
            some = _contracted(state.filter("open > 0").select("node", "least"), state.select("node"), own)
            if some is not None:
                rest, own, gone = some
                aside.append(gone)
                state = _opened(rest, own).unionByName(state.filter("open = 0"))
    stuck = state.select("node", F.lit(None).cast("long").alias("depth"))
    out = stuck if out is None else out.unionByName(stuck)
    for gone in reversed(aside):  # what runs end in is done by now, or stuck
        ends = out.select(F.col("node").alias("to"), "depth")
        out = written(out.unionByName(gone.hint("merge").join(ends, "to").select("node", F.when(F.col("depth").isNotNull(), F.greatest("least", F.col("depth") + F.col("w"))).alias("depth"))), "depths")
    return out if most is None else out.select("node", F.coalesce("depth", F.lit(most)).cast("long").alias("depth"))


def _opened(state: DataFrame, own: DataFrame) -> DataFrame:
    """(node, open, least): with the number of targets of each node."""
    n = own.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open"))
    return written(state.hint("merge").join(n, "node", "left").select("node", F.coalesce("open", F.lit(0)).cast("long").alias("open"), "least"), "depth-state")


def _contracted(rest: DataFrame, there: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Open nodes (node, least) without those that have one target ``there`` and whose run of such nodes ends; the edges (src, dst, w) of the
    others, which lead to the ends of runs; and the nodes taken out: (node, to, least, w), whose depth is the greater of least and that of
    ``to`` plus w. None, if fewer than a quarter are such nodes."""
    inner = written(own.hint("merge").join(rest.select(F.col("node").alias("src")), "src", "left_semi").hint("merge").join(there.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w"), "depth-open")
    single = inner.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"), F.min("w").alias("w")).filter("n = 1").hint("merge").join(rest, "node").select("node", "to", "least", "w")
    jumps = written(single, "depth-jumps")
    n = jumps.count()
    if 4 * n < rest.count():
        return None
    begins = jumps.select(F.col("node").alias("to"))
    jumps = written(jumps.hint("merge").join(begins.withColumn("on", F.lit(True)), "to", "left").select("node", "to", "least", "w", F.coalesce("on", F.lit(False)).alias("on")), "depth-jumps")
    for _ in range(n.bit_length()):
        if jumps.filter("on").isEmpty():
            break
        then = jumps.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("least").alias("l"), F.col("w").alias("v"), F.col("on").alias("still"))
        further = jumps.filter("on").hint("merge").join(then, "to").select("node", F.col("end").alias("to"), F.greatest("least", F.col("l") + F.col("w")).alias("least"), (F.col("w") + F.col("v")).alias("w"), F.col("still").alias("on"))
        jumps = written(jumps.filter("NOT on").unionByName(further), "depth-jumps")
    gone = jumps.filter("NOT on").drop("on")  # the others run into a cycle of such nodes
    ends = gone.select(F.col("node").alias("dst"), "to", F.col("least").alias("l"), F.col("w").alias("v"))
    led = inner.hint("merge").join(gone.select(F.col("node").alias("src")), "src", "left_anti").hint("merge").join(ends, "dst", "left")
    kept = rest.hint("merge").join(gone.select("node"), "node", "left_anti")
    floor = led.filter("to IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.max(F.col("l") + F.col("w")).alias("d"))
    kept = written(kept.hint("merge").join(floor, "node", "left").select("node", F.greatest("least", F.coalesce("d", F.lit(0))).alias("least")), "depth-kept")
    led = written(led.groupBy("src", F.coalesce("to", "dst").alias("dst")).agg(F.max(F.col("w") + F.coalesce("v", F.lit(0))).alias("w")), "depth-edges")
    return kept, led, gone


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles: strongly connected components of two nodes or more, or of one with an edge to itself, named by their least node.

    What peeling sinks or sources takes off is on no cycle. In the rest every node takes the least node that reaches it;
    the nodes of one such name that also reach it are a component. Nodes between cycles are left over, and so is what lies
    behind a cycle that has a lesser node: those go into the next pass, with the edges within a name only.
    """
    ends = edges.select("src", "dst").distinct().hint("merge").join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").hint("merge").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    ends = written(ends, "scc-edges")
    out = ends.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    within = lambda e, some: e.hint("merge").join(some.select(F.col("node").alias("src")), "src", "left_semi").hint("merge").join(some.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    rest = ends.filter("src != dst")
    while True:
        for turn in (lambda e: e, turned):
            there = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node")))
            rest = written(within(rest, depths(turn(rest), there).filter("depth IS NULL")), "scc-edges")
        if rest.isEmpty():
            break
        names = spread(rest.select(F.col("src").alias("node"), F.col("src").alias("value")), rest.select(F.col("src").alias("node"), F.col("dst").alias("next")))
        a, b = names.select(F.col("node").alias("src"), F.col("value").alias("name")), names.select(F.col("node").alias("dst"), F.col("value").alias("other"))
        rest = written(rest.hint("merge").join(a, "src").hint("merge").join(b, "dst").filter("name = other").select("src", "dst"), "scc-edges")
        found = spread(names.filter("node = value"), rest.select(F.col("dst").alias("node"), F.col("src").alias("next")))
        found = written(found.select("node", F.col("value").alias("component")), "scc-found")
        whole = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(found.hint("merge").join(whole.select("component"), "component", "left_semi").select("node", "component"))
        gone = found.select("node")
        rest = written(rest.hint("merge").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").hint("merge").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc-edges")
    return out.groupBy("node").agg(F.min("component").alias("component"))


def cyclic_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle; those between two cycles don't."""
    return components(edges, nodes).select("node")


def cyclic_refs(edges: DataFrame, on_cycles: DataFrame) -> DataFrame:
    """(node, cyclic_refs): the number of distinct targets by which a node closes a cycle, i.e. that lie in its own component (node, component)."""
    a, b = on_cycles.select(F.col("node").alias("src"), "component"), on_cycles.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inner = edges.select("src", "dst").distinct().hint("merge").join(a, "src").hint("merge").join(b, "dst").filter("component = other")
    return inner.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("cyclic_refs"))


def maintained(edges: DataFrame, old: DataFrame, seeds: DataFrame, held: DataFrame | None = None, rounds: int | None = None) -> DataFrame | None:
    """(node, depth) of the nodes whose depth changes, after the targets of the ``seeds`` changed in ``edges``; ``old``: (node, depth) before, null counting as 0.

    Driven by changes: a round reads the targets of the nodes that may change, and goes on to those before the ones that did. Where
    a depth doesn't change nothing goes on. ``held``: (node, component) of nodes on cycles; an edge within a component counts its target's
    old depth, as a walk does that meets a node it is in. If there are cycles besides, depths would rise for ever:
    after ``rounds`` (by default twice the greatest old depth and 16 more) the result is None.
    """
    pairs = edges.select("src", "dst").distinct().hint("merge").join(old.select(F.col("node").alias("dst")), "dst", "left_semi").withColumn("held", F.lit(False))
    if held is not None:
        a, b = held.select(F.col("node").alias("src"), "component"), held.select(F.col("node").alias("dst"), F.col("component").alias("other"))
        pairs = pairs.hint("merge").join(a, "src", "left").hint("merge").join(b, "dst", "left").select("src", "dst", F.coalesce(F.col("component") == F.col("other"), F.lit(False)).alias("held"))
    pairs = written(pairs.select("src", "dst", "held"), "maintain-edges")
    before = written(old.select("node", F.coalesce("depth", F.lit(0)).cast("long").alias("was"), F.col("depth").isNull().alias("new")), "maintain-old")
    if rounds is None:
        rounds = 2 * (before.agg(F.max("was")).first()[0] or 0) + 16
    frontier, delta = seeds.select("node").distinct().hint("merge").join(before.select("node"), "node", "left_semi"), None
    for n in range(rounds):
        out = frontier.hint("merge").join(pairs.withColumnRenamed("src", "node"), "node").hint("merge").join(before.select(F.col("node").alias("dst"), F.col("was").alias("to")), "dst")
        if delta is not None:
            out = out.hint("merge").join(delta.select(F.col("node").alias("dst"), "depth"), "dst", "left").withColumn("to", F.when(F.col("held"), F.col("to")).otherwise(F.coalesce("depth", "to")))
        again = frontier.hint("merge").join(out.groupBy("node").agg((F.max("to") + 1).alias("d")), "node", "left").select("node", F.coalesce("d", F.lit(0)).cast("long").alias("depth"))
        now = before if delta is None else before.hint("merge").join(delta, "node", "left").select("node", F.coalesce("depth", "was").alias("was"), (F.col("new") & F.col("depth").isNull()).alias("new"))
        changed = written(again.hint("merge").join(now, "node").filter("depth != was OR new").select("node", "depth"), "maintain")
        if changed.isEmpty():
            return delta if delta is not None else changed
        delta = changed if delta is None else delta.hint("merge").join(changed, "node", "left_anti").unionByName(changed)
        if n % 4 == 3:
            delta = written(delta, "maintain-delta")
        frontier = pairs.filter("NOT held").hint("merge").join(changed.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
    return None


def graph_summary(nodes: DataFrame) -> DataFrame:
    """One row over (depth, cross_file_imports, cyclic_refs, exports): the deepest, the sums and the number of symbols."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.agg(zero(F.max("depth")).alias("max_depth"), zero(F.sum("cross_file_imports")).alias("cross_file_refs"), zero(F.sum("cyclic_refs")).alias("cyclic_edges"), zero(F.sum("exports")).alias("symbols"))


def replaced_edges(edges: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the out-edges of changed files replaced."""
    return edges.hint("merge").join(changed.select(F.col("path").alias("src")), "src", "left_anti").unionByName(new)


def without_file(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some files; edges of their importers stay until those are refreshed."""
    return nodes.hint("merge").join(gone.select("path"), "path", "left_anti"), edges.hint("merge").join(gone.select(F.col("path").alias("src")), "src", "left_anti")


def latest_nodes(chunks: DataFrame) -> DataFrame:
    """One row per path of (path, seq, ...), the last write; it keeps the place of the first."""
    w = W.partitionBy("path")
    return chunks.withColumn("place", F.min("seq").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("seq")))).filter("r = 1").drop("r")


def walk(start, edges: dict) -> tuple[int, list]:
    """Depth first with a stack: the greatest depth at a first visit, and the nodes met again in order, with repeats."""
    seen, stack, deepest, again = set(), [(start, 0)], 0, []
    while stack:
        node, d = stack.pop()
        if node in seen:
            again.append(node)
            continue
        seen.add(node)
        deepest = max(deepest, d)
        stack += [(t, d + 1) for t in edges.get(node, ())]
    return deepest, again


def walked_metrics(edges: DataFrame, nodes: DataFrame, project: str = "project") -> DataFrame:
    """(project, node, depth, cyclic_refs, cyclic_edges) in the stack order of a sequential walk, which calls diamonds cycles.

    The order of a walk is that of its project's edges (project, src, pos, dst), so a project is what one task holds; all
    projects are spread over the tasks. For graphs of any size there is ``depths``.
    """
    ship(nodes.sparkSession)
    kind, group = nodes.schema["node"].dataType.simpleString(), nodes.schema[project].dataType.simpleString()

    def run(key: tuple, own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        table: dict = {}
        for src, dst in lines.sort_values(["src", "pos", "dst"], kind="stable")[["src", "dst"]].itertuples(index=False):
            table.setdefault(src, []).append(dst)
        found = [(n, *walk(n, table)) for n in own["node"]]
        return pd.DataFrame({project: [key[0]] * len(found), "node": [n for n, *_ in found], "depth": [d for _, d, _ in found], "cyclic_refs": [list(dict.fromkeys(a)) for *_, a in found], "cyclic_edges": [len(a) for *_, a in found]})

    own = lambda df, *columns: df.select(*[F.col(c).alias(c) for c in (project, *columns)]).groupBy(project)  # noqa: E731  columns of its own for each side
    both = own(nodes, "node").cogroup(own(edges, "src", "pos", "dst"))
    return both.applyInPandas(run, f"{project} {group}, node {kind}, depth long, cyclic_refs array<{kind}>, cyclic_edges long")


@dataclass
class Updated:
    """A graph after changes: nodes (path, depth, cross_file_imports, cyclic_refs, exports), edges (src, pos, dst) and one row of sums."""

    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def file_edges(imports: DataFrame, files: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """Edges of some files (path) only: their imports are resolved anew."""
    return graph_edges(imports.hint("merge").join(some.select(F.col("path").alias("file_path")), "file_path", "left_semi"), files, nodes)


def updated(nodes: DataFrame, edges: DataFrame, imports: DataFrame, files: DataFrame, changed: DataFrame) -> Updated:
    """The graph after some files (path) were changed, added or removed; only what depends on them is computed again.

    Edges of the changed files and of all files that could mean them are resolved anew. Depths follow the changes
    (``maintained``). Only if they don't settle, the nodes that reach a change are searched for cycles; edges
    within a cycle then count their target's old depth. The cyclic references of all nodes that reach a change
    are cleared, and found again by a full run only.
    """
    there = nodes.select("path")
    refresh = written(changed.select("path").unionByName(potential_importers(imports, changed).select(F.col("importer").alias("path"))).distinct().hint("merge").join(there, "path", "left_semi"), "graph-refresh")
    now = written(replaced_edges(edges, refresh, file_edges(imports, files, there, refresh)).hint("merge").join(there.withColumnRenamed("path", "dst"), "dst", "left_semi").hint("merge").join(there.withColumnRenamed("path", "src"), "src", "left_semi").select("src", "pos", "dst"), "graph-edges")
    seeds = refresh.select(F.col("path").alias("node"))
    affected = written(reachable(now, seeds).select("node"), "graph-affected")
    old = nodes.select(F.col("path").alias("node"), "depth")
    new = maintained(now, old, seeds)
    if new is None:
        inner = now.hint("merge").join(affected.withColumnRenamed("node", "src"), "src", "left_semi")
        new = maintained(now, old, affected, written(components(inner, affected), "graph-cycles"), rounds=1 << 30)
    new = affected.withColumn("again", F.lit(True)).hint("merge").join(new.withColumnRenamed("depth", "new_depth"), "node", "left").select(F.col("node").alias("path"), "new_depth", "again")
    cross = cross_imports(now.hint("merge").join(refresh.withColumnRenamed("path", "src"), "src", "left_semi")).withColumnRenamed("src", "path").withColumnRenamed("cross_file_imports", "new_cross")
    fresh = refresh.hint("merge").join(cross, "path", "left").select("path", F.coalesce("new_cross", F.lit(0)).alias("new_cross"))
    rows = nodes.hint("merge").join(new, "path", "left").hint("merge").join(fresh, "path", "left").select(
        "path",
        F.coalesce("new_depth", "depth").cast("long").alias("depth"),
        F.coalesce("new_cross", "cross_file_imports").cast("long").alias("cross_file_imports"),
        F.when(F.col("again"), 0).otherwise(F.col("cyclic_refs")).cast("long").alias("cyclic_refs"),
        "exports",
    )
    rows = written(rows, "graph-nodes")
    return Updated(rows, now, graph_summary(rows))
