"""Importance resampling of documents towards a target distribution, over hashed counts of word runs.

Each task builds tries of the word runs in its partition, a bounded number of words at a time. A node holds how often
its run occurs and the CRC state after it, so a run's bucket costs one CRC over its last word, once a node. Bucket totals
of all tries are merged; the logarithm of the two distributions is a gain per bucket. Documents are scored by walking
tries whose nodes have gains attached, and the highest scores plus Gumbel noise are drawn: a sample without
replacement in proportion to the weights.

A trie is kept by level: a node is a number, told by its parent's number and its last word's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from .common import ship, tidy, written

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # over UTF-8 with A-Z lowered: ASCII letters and digits, and all that isn't ASCII
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
AT_ONCE = 400_000  # words of a trie


class _Vocabulary(dict):
    """Words by number, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Trie:
    """The runs of 1 to ``longest`` words of some texts: by level, each run's node, and each node's count and CRC state."""

    def __init__(self, longest: int):
        self.longest, self.words, self.sizes, self.tails, self.texts = longest, [], [], [], []

    def add(self, text: int, words: list[bytes], tail: int = 0) -> None:
        """Words of a text, its number first. The first ``tail`` ones were there before: runs that end in them don't count again."""
        self.words += words
        self.sizes.append(len(words))
        self.tails.append(tail)
        self.texts.append(text)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per level: (CRC state of each node, node of each run that counts, text of each such run)."""
        vocabulary = _Vocabulary()
        ids = np.fromiter(map(vocabulary.__getitem__, self.words), np.int64, len(self.words))
        known, sizes = list(vocabulary), np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        end, fresh, text = (np.repeat(x, sizes) for x in (ends, ends - sizes + np.array(self.tails, np.int64), np.array(self.texts, np.int64)))
        at, node, states = np.arange(len(ids)), ids, np.array([crc32(w) for w in known], np.int64)
        for d in range(1, self.longest + 1):
            if d > 1:
                fits = at + d - 1 < end[at]
                at = at[fits]
                codes, node = np.unique(node[fits] * len(known) + ids[at + d - 1], return_inverse=True)
                parents, last = np.divmod(codes, max(1, len(known)))
                after = [crc32(b" ", s) for s in states.tolist()]  # once a parent
                states = np.array([crc32(known[w], after[p]) for p, w in zip(parents.tolist(), last.tolist(), strict=True)], np.int64)
            counts = at + d - 1 >= fresh[at]
            yield states, node[counts], text[at[counts]]


def parts(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them were there before) of a text, lowered; very long ones come in parts that overlap."""
    low = text.translate(LOW)
    if len(low) <= AT_ONCE:
        yield WORDS.findall(low), 0
        return
    met, tail = (m.group() for m in WORDS.finditer(low)), []
    while own := list(islice(met, AT_ONCE)):
        words = tail + own
        yield words, len(tail)
        tail = words[max(0, len(words) - longest + 1) :] if longest > 1 else []


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(texts: DataFrame, text_col: str = "text", *, longest: int = 2, n_buckets: int = 10_000) -> np.ndarray:
    """How many runs of 1 to ``longest`` words fall in each bucket, over all rows (repeated rows count again). What reaches the driver is a row per bucket."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trie = np.zeros(n_buckets, np.int64), Trie(longest)

        def merged() -> None:
            for states, node, _ in trie.levels():
                counts = np.bincount(node, minlength=len(states))
                total[:] += np.bincount(states % n_buckets, weights=counts, minlength=n_buckets).astype(np.int64)

        for batch in batches:
            for text in _texts(batch.column(0)):
                for words, tail in parts(text, longest):
                    trie.add(0, words, tail)
                    if len(trie.words) >= AT_ONCE:
                        merged()
                        trie = Trie(longest)
        merged()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull())
    found = rows.mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # n_buckets rows at most
    out = np.zeros(n_buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A whole number per bucket: a thousand times the logarithm of how much likelier the target makes it, with one run more in each bucket."""
    t, s = target.astype(float), corpus.astype(float)
    n = float(len(t))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text", *, longest: int = 2) -> DataFrame:
    """``docs`` in a struct ``row``, with n_words, n_features and weight, the floored mean gain of its runs (0 without any). Whole texts, where they are read."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_runs, total = np.zeros((3, n), np.int64)
            trie = Trie(longest)

            def walked(trie: Trie) -> None:
                for d, (states, node, text) in enumerate(trie.levels()):
                    attached = table[states % len(table)]
                    met = np.bincount(text, minlength=n)
                    n_words[:] += met if d == 0 else 0
                    n_runs[:] += met
                    total[:] += np.bincount(text, weights=attached[node], minlength=n).astype(np.int64)  # whole numbers far below 2**53

            for i, x in enumerate(_texts(batch.column(1))):
                for words, tail in parts(x, longest):
                    trie.add(i, words, tail)
                    if len(trie.words) >= AT_ONCE:
                        walked(trie)
                        trie = Trie(longest)
            walked(trie)
            weight = np.where(n_runs > 0, total // np.maximum(n_runs, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(a) for a in (n_words, n_runs, weight))], names=["row", "n_words", "n_features", "weight"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, floored, from the sha256 of seed and id (a null id counts as an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, least_words: int = 20, longest: int = 2, n_buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank.

    Of the documents with ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest score are drawn, ties to the smaller id
    (a null one first); rank is their place from 1, null for all others. Null, empty and wordless texts have no runs and
    weight 0; repeated rows are rows of their own and their texts count again. Without documents, or without a target, nothing breaks: then every bucket counts one. Further columns, whatever their
    names, are ignored.

    Texts are read twice, by tasks of their own; then only ids and numbers move, once, to be ordered in ranges.
    """
    gain = gains(bucket_counts(target, longest=longest, n_buckets=n_buckets), bucket_counts(docs, text_col, longest=longest, n_buckets=n_buckets))
    rows = weighted(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), gain, longest=longest)
    rows = written(rows.select("row.doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise("row.doc_id", seed)).alias("score")), "importance")
    drawn = rows.filter(F.col("n_words") >= least_words).count() * percent // 100
    ranked = numbered(rows.filter(F.col("n_words") >= least_words), F.col("score"), F.col("doc_id"), name="nth", descending=True)
    ranked = ranked.withColumn("rank", F.when(F.col("nth") <= drawn, F.col("nth"))).drop("nth")
    out = ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
