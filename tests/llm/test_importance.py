import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import importance

from .helpers import prose, rows, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def runs_of(text, longest=2):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n_buckets=10_000, percent=25, least=20, longest=2):
    """(id, text) of documents and target texts: by definition, run by run."""
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs_of(x, longest)), Counter(bucket(f) for x in target for f in runs_of(x, longest))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + float(n_buckets)) / ((s[b] + 1.0) * (tt + float(n_buckets)))))
    out = []
    for i, x in docs:
        f = runs_of(x, longest)
        weight = sum(gain(bucket(r)) for r in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture(scope="module")
def target(spark):
    import random

    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(5)] + [None, "", "one two THREE", "ß é ẞ \U0001f600"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_against_brute_force(spark, target):
    found = importance.resampled(table(spark), target[1])
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute([(r[0], r[1]) for r in rows()], target[0])


def test_more_drawn_other_lengths_and_tries_that_start_anew(spark, target, monkeypatch):
    docs = [(i, f"same words here {i % 3} again and again", "en", "a", 0, 1, "", "", "", 0.0) for i in range(40)] + [(5, None, "en", "a", 0, 1, "", "", "", 0.0)]
    for k, longest, n_buckets in ((1, 1, 7), (60, 3, 50)):
        found = importance.resampled(table(spark, docs), target[1], percent=60, least_words=k, longest=longest, n_buckets=n_buckets).collect()
        assert sorted(map(tuple, found), key=str) == brute([d[:2] for d in docs], target[0], n_buckets, 60, k, longest)


def test_tries_in_parts(monkeypatch):
    """Texts longer than a trie come in parts; every run is met once, whatever the limit."""
    text = "A b c D e f g h i J k l m ñ o 1 2 3 ß\U0001f600 x" * 3
    for most in (1, 2, 4, 7, 10**6):
        monkeypatch.setattr(importance, "AT_ONCE", most)
        for longest in (1, 2, 3, 6):
            found = Counter()
            trie = importance.Trie(longest)
            for words, tail in importance.parts(text.encode(), longest):
                trie.add(0, words, tail)
            for states, node, own in trie.levels():
                found.update(states[node].tolist())
                assert not own.any()
            assert found == Counter(zlib.crc32(r.encode()) for r in runs_of(text, longest))


def test_small_tries_agree(spark, target, monkeypatch):
    """The limit of words is crossed many times over within a task: totals and weights stay the same."""
    import pyarrow as pa

    docs = [(r[0], r[1]) for r in rows()]
    frames = []

    class Frame:  # runs the task's function here, where the limit can be set
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            frames.append([b.to_pylist() for b in run(iter([pa.RecordBatch.from_pydict({"text": [t for _, t in docs if t is not None]})]))])
            return self

        def collect(self):
            return frames[-1][0]

    want = Counter(zlib.crc32(f.encode()) % 10_000 for _, x in docs for f in runs_of(x))
    for most in (3, 1000):
        monkeypatch.setattr(importance, "AT_ONCE", most)
        got = importance.bucket_counts(Frame())
        assert {int(b): int(got[b]) for b in np.flatnonzero(got)} == dict(want)


def test_no_rows(spark, target):
    assert importance.resampled(table(spark, []), target[1]).collect() == []
    found = importance.resampled(table(spark), target[1].limit(0)).collect()
    assert sorted(map(tuple, found), key=str) == brute([(r[0], r[1]) for r in rows()], [])


def test_query_on_whole_tables(spark):
    import pyarrow.parquet as pq

    from loomline.llm import queries_corpus

    sf = "/root/testdata/sf0.001"
    docs, items = pq.read_table(f"{sf}/documents.parquet").to_pylist(), pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    found = queries_corpus.op11_importance_resampling(spark, sf).collect()
    assert sorted(map(tuple, found), key=str) == brute([(d["doc_id"], d["text"]) for d in docs], [x["text"] for x in items])
