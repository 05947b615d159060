import random
from collections import defaultdict

import numpy as np

from loomline.llm import ann, components, dedup

from .helpers import prose, rows, table


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b"|".join(w)] if w else [])


def brute_components(data, percent):
    sets = [shingles(d[1]) for d in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, d in enumerate(data):
        if d[0] is not None:
            least[root(i)].append(d[0])
    return [(d[0], len(sets[i]), min(least[root(i)], default=None) if sets[i] else d[0]) for i, d in enumerate(data)]


def edited(rng, words, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in words)


def chains(n=150):
    """Groups whose pairs lie on both sides of the threshold, so that components hang on single links."""
    rng = random.Random(9)
    out, k = [], 0
    for _ in range(6):
        words = prose(rng, 120).split()
        for _ in range(n // 6):
            text = edited(rng, words, rng.choice([0.0, 0.005, 0.01, 0.02, 0.04]))
            out.append((k, text, "en", "a", len(text), 0, "", "", "", 0.0))
            k += 7
    rng.shuffle(out)
    return out


def check(spark, data, percent):
    got = dedup.near_duplicates(table(spark, data), percent=percent).collect()
    want = brute_components(data, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    check(spark, rows(), 85)


def test_components_by_brute_force(spark):
    for percent in (80, 85):
        check(spark, chains(), percent)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    check(spark, chains(90), 85)


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MOST_BROADCAST", 0)
    check(spark, chains(48), 85)


def test_empty_and_unique(spark):
    assert dedup.near_duplicates(table(spark, [])).collect() == []
    check(spark, [d for d in rows() if d[0] and d[0] >= 100], 85)


def test_one_document_of_each_group_stays(spark):
    data = [(10_000 + d[0], *d[1:]) for d in chains(60)] + rows()
    kept = dedup.deduplicate(table(spark, data), percent=80)
    assert kept.columns == table(spark, data).columns
    got = kept.collect()
    blank = sum(not shingles(d[1]) for d in data)
    groups = {c for (_, n, c), d in zip(brute_components(data, 80), data, strict=True) if n and d[0] is not None}
    assert sum(not shingles(r.text) for r in got) == blank
    assert {r.doc_id for r in got if shingles(r.text) and r.doc_id is not None} == groups
    assert len([r for r in got if shingles(r.text) and r.doc_id is not None]) == len(groups) + 1  # two texts share the id 14


def test_match_threshold_keeps_the_risk():
    t = dedup.match_threshold(0.85)
    rng = np.random.default_rng(0)
    assert (rng.binomial(64, 0.85, 400_000) < t).sum() <= 3 and t > 30


def test_stars(spark):
    rng = random.Random(10)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, list int, query_id string")


def brute_nearest(data, k=5, every=50):
    keep = [(i, np.array(v, float)) for i, v, *_ in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, v in keep:
        if q % every == 0:
            s = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in keep if i != q)[:k]
            out[q] = [i for _, i in s]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0, 1, "x") for i in range(900)]
    data += [(1000 + i, data[3][1], 0, 1, "x") for i in range(300)]  # a very common vector
    data += [(2000, None, 0, 1, "x"), (2050, [0.0] * 8, 0, 1, "x"), (2100, [float("nan")] + [1.0] * 7, 0, 1, "x"), (2150, [None] + [1.0] * 7, 0, 1, "x"), (2200, [1.0] * 3, 0, 1, "x"), (None, [1.0] * 8, 0, 1, "x"), (2250, [float("inf")] + [1.0] * 7, 0, 1, "x")]
    small = ann.Settings(list_size=32, block_bytes=64 * 64, least_vectors=64, region=4)
    got = defaultdict(dict)
    for r in ann.nearest(vectors(spark, data), settings=small).collect():
        got[r.query_id][r.rank] = r.vec_id
    want = brute_nearest(data)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len(set(got[q].values()) & set(want[q])) for q in want)
    assert hits / (5 * len(want)) > 0.95
    assert [got[1000][r] for r in range(1, 6)] == want[1000]  # ties go to smaller ids


def searched(v, queries, s):
    """(recall of 5, share of the rows that a query meets) outside Spark, by the operator's own parts."""
    v = ann.unit(v)
    c = ann.halved(v, max(1, min(len(v) // 8, -(-len(v) // s.list_size))))
    at, lists, primary = ann.assigned(v, c, s)
    graph = ann.CentroidGraph(c, np.bincount(lists, minlength=len(c)), s)
    members, hits, scanned = [at[lists == i] for i in range(len(c))], 0, 0
    for q in queries:
        near, broad = ann.taken(graph, v[q])
        rows = np.arange(len(v)) if broad else np.concatenate([members[i] for i in near])
        scanned += len(rows)
        rows = np.unique(rows)
        got, want = (x[np.argsort(-(v[x] @ v[q]), kind="stable")[1:6]] for x in (rows, np.arange(len(v))))
        hits += len(np.intersect1d(got, want))
    return hits / 5 / len(queries), scanned / len(v) / len(queries)


def test_recall_under_pruning():
    """Clustered vectors: few are met and nearly all neighbours found. Vectors without structure: each is met once at most."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    for noise, most in ((0.1, 0.3), (0.3, 0.4), (0.6, 0.7)):
        v = centres[rng.integers(0, 100, 20_000)] + noise * rng.normal(size=(20_000, 32))
        recall, share = searched(v, range(0, 20_000, 400), ann.Settings())
        assert recall > 0.97 and share < most, (noise, recall, share)
    recall, share = searched(rng.normal(size=(20_000, 32)), range(0, 20_000, 400), ann.Settings())
    assert recall > 0.97 and share <= 1.0, (recall, share)


def test_proportional_vectors_and_other_lengths(spark):
    base = [0.3, -0.7, 0.2, 0.9, 0.1, 0.4, -0.2, 0.6]
    data = [(i, [x * (1 + i % 97) for x in base], 0, 1, "x") for i in range(300)] + [(1000 + i, [1.0, float(i), 2.0], 0, 1, "x") for i in range(60)]
    got = defaultdict(dict)
    for r in ann.nearest(vectors(spark, data)).collect():
        got[r.query_id][r.rank] = r
    assert all(-1 <= r.score <= 1 for g in got.values() for r in g.values())
    assert {r.vec_id >= 1000 for r in got[1050].values()} == {True} and [got[1050][k].vec_id for k in (1, 2)] == [1051, 1049]
    for q in range(0, 300, 50):
        v = {i: np.array(np.float32(x), float) for i, x, *_ in data[:300]}
        cos = {i: min(1.0, float((w * v[q]).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v[q] * v[q]).sum())))) for i, w in v.items() if i != q}
        assert [got[q][k].vec_id for k in range(1, 6)] == sorted(cos, key=lambda i: (-cos[i], i))[:5]


def test_very_large_and_very_small_components(spark):
    """Each vector over or below what squares of doubles can hold: rows and scores are those of the same directions at size 1."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 6))
    sizes = rng.choice([1e200, 1e-200, 1e300, 1e-290, 1.0], 60)
    powers = 2.0 ** np.floor(np.log2(sizes))  # so that directions are equal to the last bit
    frame = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = sorted(tuple(r) for r in ann.nearest(frame(base), every=10).collect())
    assert len(want) == 30 and sorted(tuple(r) for r in ann.nearest(frame(base * powers[:, None]), every=10).collect()) == want


def test_few_and_no_vectors(spark):
    assert ann.nearest(vectors(spark, [])).collect() == []
    few = [(i, [1.0, float(i)], 0, 0, "") for i in (0, 50, 51)]
    got = ann.nearest(vectors(spark, few)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 51), (50, 1, 51), (50, 2, 0)]


def test_graph_reaches_every_list():
    c = ann.unit(np.random.default_rng(2).normal(size=(100, 8)))
    g = ann.CentroidGraph(c, np.ones(100), ann.Settings(ratio=100.0, least_vectors=1000))
    assert sorted(g.search(c[0])) == list(range(100))


def test_unrelated_texts_share_no_value():
    """Minima of large sets lie close together; their values must not, or unrelated documents of a large table meet."""
    rng = np.random.default_rng(4)
    sig = dedup.signatures([np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64)) for _ in range(400)])
    assert sig.dtype == np.uint64 and len(np.unique(sig)) == sig.size
    high = sig.ravel() >> np.uint64(32)  # spread over the whole range: neither half of a value is poor
    assert len(np.unique(high)) > 0.999 * sig.size and abs(float(np.mean(high >> np.uint64(31))) - 0.5) < 0.02


def test_long_words_do_not_collide():
    """Thue-Morse words of two letters have the same polynomial modulo 2**64 as their mirror."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    a, b = dedup.gram_sets([word, word.translate(str.maketrans("ab", "ba"))])
    assert a[0] != b[0]


def test_each_pair_is_counted_in_its_first_list_only():
    import pyarrow as pa

    def block(rows, more=()):
        side = pa.array([0] * len(rows) + [1] * len(more), pa.int32())
        rows = [*rows, *more]
        return pa.table({"side": side, "k": [7] * len(rows), "token": pa.array([5] * len(rows), pa.int64()), "node": pa.array([r[0] for r in rows], pa.int64()), "component": pa.array([r[1] for r in rows], pa.int64()), "sig": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "lists": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    same, other = [1] * 64, list(range(64))
    met = dedup._suspects(40)(block([(1, 1, same, [5, 9]), (2, 2, same, [2, 5]), (3, 3, other, [5])]))
    assert sorted(zip(met["side"].to_pylist(), met["node"].to_pylist(), strict=True)) == [(0, 1), (1, 2)]
    assert dedup._suspects(40)(block([(1, 1, same, [2, 5]), (2, 2, same, [2, 5])])).num_rows == 0
    assert dedup._suspects(40)(block([(1, 1, same, [5])], [(4, 1, same, [5])])).num_rows == 0
