"""Token-ID files: one compressed wavelet matrix per shard of a range of ids, and what can be asked of it.

A shard is a Parquet file of one row, written through Spark (so it is committed whole or not at all and can lie in any
store that Spark writes to): the ids and lengths of its documents and the wavelet matrix of its tokens. Tokens at places,
counts and occurrences are answered from the matrix alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import partitions, scratch_path, ship, tidy
from .pieces import PieceCache, assumed, slices
from .wavelet import WaveletMatrix

_OPEN: dict[str, PieceCache] = {}


def opened(path: str) -> PieceCache:
    """A cache over the tokenizers library's tokenizer: a piece becomes its ids as little-endian 32-bit integers."""
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        letters = {b: c for c, b in byte_letters().items()}
        space = letters[ord(" ")]
        model = t.model  # the library's BPE model: the pieces of a text are what it is given

        def encode(piece: str) -> bytes:
            word = piece[1:] if piece[0] == " " else piece
            if word.isascii() and word.isalpha():  # such letters stand for themselves
                spelled = space + word if piece[0] == " " else piece
            else:
                spelled = "".join([letters[b] for b in piece.encode()])
            ids = [x.id for x in model.tokenize(spelled)]
            return struct.pack(f"<{len(ids)}I", *ids)

        assumed(path)
        _OPEN[path] = PieceCache(encode, {a.content: struct.pack("<I", i) for i, a in t.get_added_tokens_decoder().items()}, most=1_600_000)
    return _OPEN[path]


HEAD = 32  # letters of a text that tell rows of one id apart in the ranges of shards; the bounds that Spark samples hold them
SCHEMA = "shard int, n_tokens long, ids array<long>, lengths array<int>, matrix binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, shards: int | None = None, shard_bytes: int = 16_000_000, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty) in ascending id order (nulls first, ties by text) and write one file per shard.

    Without ``shards``, as many as keep each at about ``shard_bytes`` of text, and at least the session's shuffle
    partitions. Rows of one id (or none) are cut too, by the first letters of their texts; only those that agree in these as well
    share a shard. A task holds the tokens of one shard, 2 bytes each; a document is never cut, so one longer than a shard
    fills its own.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ids, lengths, parts = opened(tokenizer), [], [], []
        end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        narrow = np.uint16 if bits <= 16 else np.uint32
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, part in slices(batch.column(1)):
                ids += keys[at : at + len(part)]
                raw = [b"".join(cache.text(text)) + end for text in part]
                lengths += [len(x) // 4 for x in raw]
                tokens = np.frombuffer(b"".join(raw), "<u4")
                if len(tokens) and int(tokens.max()) >> bits:
                    raise ValueError(f"an id needs more than {bits} bits")
                parts.append(tokens.astype(narrow))
        if ids:
            tokens = np.concatenate(parts)
            parts.clear()
            cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([WaveletMatrix.build(tokens, bits).dumps()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "n_tokens", "ids", "lengths", "matrix"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(spark), -(-size // shard_bytes))
    head = F.substring("text", 1, HEAD)  # many rows of one id are cut by how their texts begin
    rows = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), head.asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows.mapInArrow(tidy(run), SCHEMA).write.parquet(path)


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The shards, and (shard, before): the number of tokens in all shards before it."""
    ship(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    before, offsets = 0, []
    for r in sorted(files.select("shard", "n_tokens").collect()):  # a row per shard
        offsets.append((r["shard"], before))
        before += r["n_tokens"]
    return files, F.broadcast(spark.createDataFrame(offsets, "shard int, before long"))


def read_shards(spark: SparkSession, path: str, *, keep_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (tokens before it in all shards), n_tokens, ids_crc32 and, with ``keep_ids``, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k] for name in ("shard", "ids", "lengths", "matrix")}
                tokens = WaveletMatrix.loads(r["matrix"].as_py()).all()
                lengths, keys = np.asarray(r["lengths"].values, np.int64), r["ids"].values
                ends = np.cumsum(lengths)
                for lo in range(0, len(lengths), 1000):
                    a, b = (ends - lengths)[lo : lo + 1000], ends[lo : lo + 1000]
                    own, base = tokens[a[0] : b[-1]].astype("<u4"), a[0]
                    cols = [keys.slice(lo, len(a)), pa.array([r["shard"].as_py()] * len(a), pa.int32()), pa.array(a), pa.array(b - a), pa.array([zlib.crc32(own[x - base : y - base]) for x, y in zip(a, b, strict=True)], pa.int64())]
                    names = ["id", "shard", "within", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        cols, names = [*cols, pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - base, pa.int32()), pa.array(own.astype(np.int32)))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    files, offset = _files(spark, path)
    docs = files.select("shard", "ids", "lengths", "matrix").mapInArrow(tidy(run), "id long, shard int, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    return docs.join(offset, "shard").select(F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))  # a row per shard is sent


def _asked(spark: SparkSession, path: str, ask, schema: str) -> DataFrame:
    """``ask(matrix, before)`` of every shard gives columns; before: tokens in the shards before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict(ask(WaveletMatrix.loads(data.as_py()), before))

    files, offset = _files(spark, path)
    return files.select("shard", "matrix").join(offset, "shard").select("before", "matrix").mapInArrow(tidy(run), schema)


def tokens_at(spark: SparkSession, path: str, places: Sequence[int]) -> DataFrame:
    """(place, token) for a batch of places in the whole corpus, places outside aside; each shard answers its own by access."""
    wanted = np.unique(np.asarray(places, np.int64))

    def ask(m: WaveletMatrix, before: int) -> dict:
        own = wanted[np.searchsorted(wanted, before) : np.searchsorted(wanted, before + m.n)]
        found = m.take(own - before) if len(own) > 64 else [m.access(int(i)) for i in own - before]
        return {"place": pa.array(own), "token": pa.array(np.asarray(found, np.int64), pa.int64())}

    return _asked(spark, path, ask, "place long, token long")


def token_counts(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """(token, n): how often each of a batch of tokens occurs in all shards, by two ranks per plane and shard."""
    wanted = sorted(set(tokens))

    def ask(m: WaveletMatrix, before: int) -> dict:
        return {"token": pa.array(wanted, pa.int64()), "n": pa.array([m.count(t) for t in wanted], pa.int64())}

    return _asked(spark, path, ask, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """(token, place): every occurrence of a batch of tokens, as places in the whole corpus, by select."""
    wanted = sorted(set(tokens))

    def ask(m: WaveletMatrix, before: int) -> dict:
        found = [m.places(t) + before for t in wanted]
        return {"token": pa.array(np.repeat(np.array(wanted, np.int64), [len(x) for x in found])), "place": pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))}

    return _asked(spark, path, ask, "token long, place long")


def token_file_digests(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back: id, start, n_tokens, ids_crc32.

    Texts are encoded whole, however long; a null text is an empty one, whose only token is the end. Rows with null or
    repeated ids stay rows, in the order of id (nulls first) and text; further columns, whatever their names, are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_shards(docs, path, tokenizer, **how)
    return read_shards(spark, path, keep_ids=False, id_col=how.get("id_col", "doc_id"))
