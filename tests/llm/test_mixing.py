import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from loomline.llm import mixing

from .helpers import rows, table


def targets(sizes, weights=(1, 2, 3), limit=3):
    """Resharing step by step, as a brute-force version."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(limit * sizes[s] for s in capped)
        t = {s: limit * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > limit * sizes[s]}
        if not over:
            return t
        capped |= over


def test_against_brute_force(spark):
    data = rows()
    found = mixing.mix_sources(table(spark)).collect()
    assert len(found) == len(data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
        sizes[d[3]] += n
        largest[d[3]] = max(largest[d[3]], n)
    want = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(found, key=str) == sorted(mixing.mix_sources(table(spark)).collect(), key=str)


def test_oracle_on_odd_rows(spark):
    docs = table(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.sql(mixing.ORACLE_SQL).fetchall(), key=str)
    got = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_caps_cascade(spark):
    data = [(i, "w " * n, "en", s, 0, 1, "", "", "", 0.0) for i, (s, n) in enumerate([("a", 1000), ("b", 1), ("c", 5), ("d", 50), ("e", 300), ("f", 2)])]
    want = targets({"a": 1000, "b": 1, "c": 5, "d": 50, "e": 300, "f": 2})
    assert {r.source: r.target for r in mixing.mix_sources(table(spark, data)).collect()} == pytest.approx(want)


def test_only_blank_texts_and_empty(spark):
    data = [(1, None, "en", "a", 0, 1, "", "", "", 0.0), (2, " ", "en", None, 0, 1, "", "", "", 0.0)]
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(table(spark, data)).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix_sources(table(spark, [])).collect() == []


def test_blank_documents_of_a_capped_source_have_no_more_copies(spark):
    data = [(i, "w " * 50, "en", "a", 0, 1, "", "", "", 0.0) for i in range(9)] + [(20, "w", "en", "b", 0, 1, "", "", "", 0.0), (21, "", "en", "b", 0, 1, "", "", "", 0.0), (22, None, "en", "b", 0, 1, "", "", "", 0.0)]
    assert {r.doc_id: r.copies for r in mixing.mix_sources(table(spark, data)).collect() if r.doc_id >= 20} == {20: 3, 21: 3, 22: 3}


def test_native_plan(spark):
    plan = mixing.mix_sources(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document of four times the words has about twice the odds (the tilt is the root), and words taken stay near the target."""
    from collections import Counter

    data = [(i, "w " * (4 if i % 2 else 16), "en", "ab"[i < 40], 0, 0, "", "", "", 0.0) for i in range(120)]
    taken, seeds = Counter(), 40
    mixed = lambda s: mixing.mix_sources(table(spark, data), seed=f"s{s}", bins=16).filter("copies > 0 AND source = 'a'").collect()
    with ThreadPoolExecutor(4) as pool:
        for found in pool.map(mixed, range(seeds)):
            taken.update(r.size for r in found)
    n = sum(d[3] == "a" for d in data) // 2 * seeds
    odds = {k: taken[k] / n / (1 - taken[k] / n) for k in (4, 16)}
    assert 1.5 < odds[16] / odds[4] < 2.7, odds
