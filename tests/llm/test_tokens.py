import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import bpe, pieces, token_files
from loomline.llm.queries_tokens import vocabulary_path
from loomline.llm.wavelet import WaveletMatrix

from .helpers import prose, rows, table

PATH = vocabulary_path()
REAL = Tokenizer.from_file(PATH)


def ids_of(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


odd = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "12", "'s", "'", "!", "\x1c", "\x85", "\xa0", "²", "<|endoftext|>", "<|endof", "aaaa", "́", " "]), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(odd, st.text(max_size=40)))
def test_encode_equals_the_library(text):
    vocabulary, cache, _ = bpe.opened(PATH)
    ids = [int(i) for part in cache.text(text) for i in part.split(",")]
    assert ids == ids_of(text)
    assert vocabulary.decode(ids) == REAL.decode(ids, skip_special_tokens=False)
    assert b"".join(token_files.opened(PATH).text(text)) == np.array(ids, "<u4").tobytes()


def test_long_piece_is_one_encoding():
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    vocabulary, *_ = bpe.opened(PATH)
    assert vocabulary.encode_piece(text) == ids_of(text)


def test_bytes_that_are_no_text_decode_like_the_library():
    vocabulary, *_ = bpe.opened(PATH)
    rng = random.Random(2)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert vocabulary.decode(ids) == REAL.decode(ids, skip_special_tokens=False)


def test_cache_is_bounded():
    cache = pieces.PieceCache(lambda p: p, {}, most=10, longest=5)
    for i in range(100):
        cache.text(f"w{i} abcdefghijk")
    assert len(cache) <= 14 and "abcdefghijk" not in cache


def test_documents(spark):
    got = bpe.encode_documents(table(spark), PATH).collect()
    want = []
    for d in rows():
        ids = ids_of(d[1])
        want.append((d[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(table(spark, []), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=300))
def test_wavelet_matrix(ids):
    m = WaveletMatrix.loads(WaveletMatrix.build(np.array(ids, np.uint32), 16).dumps())
    assert m.all().tolist() == ids
    for i, t in enumerate(ids):
        assert m.access(i) == t and m.rank(t, i) == ids[:i].count(t) and m.select(t, ids[:i].count(t)) == i
    assert m.count(50256) == ids.count(50256) and m.count(7) == ids.count(7)


def test_wavelet_over_many_steps():
    ids = np.random.default_rng(0).integers(0, 300, 20_000).astype(np.uint32)
    m = WaveletMatrix.loads(WaveletMatrix.build(ids, 16).dumps())
    for i in range(0, 20_000, 997):
        t = int(ids[i])
        assert m.access(i) == t and m.rank(t, i) == (ids[:i] == t).sum() and m.select(t, m.rank(t, i)) == i
    with pytest.raises(IndexError):
        m.select(5000, 0)
    with pytest.raises(ValueError):
        WaveletMatrix.build(np.array([70_000]), 16)


@pytest.mark.parametrize("how", [{"shards": 3}, {"shards": 1}, {"shard_bytes": 2000}, {}])
def test_token_files(spark, how):
    got = token_files.token_file_digests(table(spark), PATH, **how).collect()
    order = sorted(rows(), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    want, start = [], 0
    for d in order:
        ids = [*ids_of(d[1]), 2]
        want.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_file_digests(table(spark, []), PATH).collect() == []


def test_one_id_for_most_rows_is_many_shards(spark, tmp_path):
    rng = random.Random(4)
    data = [(7 if i % 4 else None, prose(rng, 6)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    token_files.write_shards(df, f"{tmp_path}/shards", PATH, shards=8)
    sizes = [len(r.ids) for r in spark.read.parquet(f"{tmp_path}/shards").collect()]
    assert sum(sizes) == 400 and len(sizes) >= 7 and max(sizes) <= 150
    read = token_files.read_shards(spark, f"{tmp_path}/shards").orderBy("start").collect()
    order = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    assert [(r.doc_id, list(r.ids)) for r in read] == [(k, [*ids_of(t), 2]) for k, t in order]


def test_shards_answer_places_counts_and_occurrences(spark, tmp_path):
    path = f"file://{tmp_path}/asked"
    token_files.write_shards(table(spark), path, PATH, shards=3)
    order = sorted(rows(), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    flat = np.array([i for d in order for i in [*ids_of(d[1]), 2]])
    assert spark.read.parquet(path).count() <= 3  # a matrix a shard
    places = [0, 1, 17, len(flat) // 2, len(flat) - 1, len(flat), -1]
    assert sorted(map(tuple, token_files.tokens_at(spark, path, places).collect())) == [(i, flat[i]) for i in places[:5]]
    many = list(range(0, len(flat), 7))
    assert [r.token for r in sorted(token_files.tokens_at(spark, path, many).collect())] == flat[many].tolist()
    asked = [2, int(flat[0]), int(flat[40]), 50_000, 70_000]
    assert {r.token: r.n for r in token_files.token_counts(spark, path, asked).collect()} == {t: int((flat == t).sum()) for t in asked}
    got = sorted(map(tuple, token_files.occurrences(spark, path, asked).collect()))
    assert got == sorted((t, int(i)) for t in set(asked) for i in np.flatnonzero(flat == t))


def test_look_ups_unpack_one_piece_of_each_plane():
    ids = np.random.default_rng(1).integers(0, 50_000, 3_000_000).astype(np.uint32)
    m = WaveletMatrix.loads(WaveletMatrix.build(ids, 16).dumps())
    assert m.access(1_234_567) == ids[1_234_567]
    assert all(len(p._open) <= 2 and p._raw is None and len(p.pieces) > 4 for p in m.planes)
    assert m.count(int(ids[5])) == (ids == ids[5]).sum() and m.places(int(ids[5])).tolist() == np.flatnonzero(ids == ids[5]).tolist()
    at = np.random.default_rng(2).integers(0, len(ids), 1000)
    assert m.take(at).tolist() == ids[at].tolist()


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**spec["model"], "ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))


def test_files_are_read_back_with_ids(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    token_files.write_shards(table(spark), path, PATH, shards=2)
    got = {(r.doc_id, tuple(r.ids)) for r in token_files.read_shards(spark, path).collect()}
    assert got == {(d[0], (*ids_of(d[1]), 2)) for d in rows()}
