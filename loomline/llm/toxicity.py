"""Toxicity: a logistic classifier over word types, regularised by counterfactuals.

Every distinct word of a text adds the weight of the word and of its first letters. For training, identity terms of the
labelled sentences are swapped for every other of their group, and into sentences of both classes that have none the terms
of a group are put one by one; changes of the score under all of these are penalised, so that naming a group isn't by
itself evidence. Terms always have weights of their own, so the penalty acts whatever the corpus holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import held_out, ship, tidy
from .pieces import slices

#: Identity terms by group, in several languages; a term is swapped for each other of its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("woman", "man"),
    ("women", "men"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("disabled", "blind", "deaf"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("ausländer", "einheimische", "flüchtlinge"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("immigrés", "autochtones", "réfugiés"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
    ("inmigrantes", "nativos", "refugiados"),
)
BUCKETS = 1 << 20
STEM = 4
_word = re.compile(r"[^\W_]+")


def types_of(text: str) -> set[str]:
    return set(_word.findall(text.lower()))


def buckets_of(word: str) -> tuple[int, ...]:
    """Of the word and, if it is longer, of its first letters."""
    whole = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return (whole,) if len(word) <= STEM else (whole, zlib.crc32(b"^" + word[:STEM].encode("utf-8", "surrogatepass")) % BUCKETS)


def counterfactuals(words: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(buckets that come, buckets that go) for each counterfactual of a sentence's words.

    Terms are swapped for every other of their group; if there are none, each term of the one group that the words choose
    (by a checksum) is put in.
    """
    own = [(w, group) for group in groups for w in group if w in words]
    if own:
        pairs = [({other}, {w}) for w, group in own for other in group if other != w and other not in words]
    else:
        group = groups[zlib.crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass")) % len(groups)] if groups else ()
        pairs = [({term}, set()) for term in group]
    spelled = lambda ws: tuple(sorted(b for w in ws for b in buckets_of(w)))
    return [(spelled(come), spelled(go)) for come, go in pairs]


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -3.0


class Scorer(dict):
    """Weight of each word met, emptied beyond a million words."""

    def __init__(self, model: Model, most: int = 1_000_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        w = self[word] = sum(self.model.weights.get(b, 0.0) for b in buckets_of(word))
        return w

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        # in a fixed order: the sum of a text doesn't depend on how its set is laid out
        z = np.array([sum(sorted(w for w in map(self.__getitem__, types_of(t)) if w)) for t in texts]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def select(rows: list[tuple[int, np.ndarray]], most: int, least_z: float) -> np.ndarray:
    """Buckets whose share of toxic and of other documents differs surely, the surest first."""
    seen, n = np.zeros((2, BUCKETS), np.float32), np.zeros(2)
    for y, ids in rows:
        n[y] += 1
        seen[y, np.unique(ids)] += 1
    some = np.flatnonzero(seen.sum(axis=0) >= 2)
    a, b = seen[1, some] + 0.5, seen[0, some] + 0.5
    z = np.abs(np.log(a / (n[1] + 1)) - np.log(b / (n[0] + 1))) / np.sqrt(1 / a + 1 / b)
    sure = z >= least_z
    return some[sure][np.argsort(-z[sure], kind="stable")[:most]]


def train(rows: list[tuple[int, np.ndarray]], changes: dict[tuple[bytes, bytes], int] | None = None, *, most_features: int = 2048, least_z: float = 2.5, fairness: float = 4.0, decay: float = 2e-4, rounds: int = 300) -> Model:
    """A model from (label, buckets of the word types) and how often each counterfactual (buckets that come, that go) occurs.

    Loss: mean log loss + ``fairness`` times the squared changes of the score over a row's counterfactuals, mean of the rows, + ``decay``/2
    times the squared weights. What the counterfactuals change are few buckets, so all of them are one small matrix.
    """
    n1 = sum(y for y, _ in rows)
    if not n1 or n1 == len(rows):
        return Model(bias=-3.0 if not n1 else 3.0)
    changes = changes or {}
    named = np.unique(np.concatenate([np.frombuffer(x, "<i4") for pair in changes for x in pair] or [np.zeros(0, np.int32)])).astype(np.int64)
    chosen = select(rows, most_features, least_z)
    chosen = np.concatenate([chosen, np.setdiff1d(named, chosen)])  # terms have weights, whether or not they are evidence
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (_, ids) in enumerate(rows):
        at = place[ids]
        np.add.at(x[i], at[at >= 0], 1)
    np.minimum(x, 3, out=x)
    y = np.array([y for y, _ in rows], np.float32)

    at = place[named]  # where the changed buckets are
    back = np.full(len(chosen), -1, np.int32)
    back[at] = np.arange(len(at))
    moved = np.zeros((len(at), len(at)), np.float32)
    for (come, go), times in sorted(changes.items()):
        d = np.zeros(len(at), np.float32)
        np.add.at(d, back[place[np.frombuffer(come, "<i4")]], 1)
        np.add.at(d, back[place[np.frombuffer(go, "<i4")]], -1)
        moved += times * np.outer(d, d)
    moved /= len(rows)

    def penalty(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        out[at] = moved @ v[at]
        return out

    w = z = np.zeros(len(chosen), np.float32)
    b = zb = float(np.log(n1 / (len(rows) - n1)))
    v, top = np.ones(len(chosen), np.float32), 1.0
    for _ in range(8):
        v = 0.25 * (x.T @ (x @ v)) / len(x) + 2 * fairness * penalty(v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (1.2 * top + 0.3 + decay)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z + zb, -30, 30)))
        grad = x.T @ (p - y) / len(x) + 2 * fairness * penalty(z) + decay * z
        new, nb = z - np.float32(step) * grad, zb - step * float((p - y).mean())
        m = k / (k + 3)
        z, zb, w, b = new + np.float32(m) * (new - w), nb + m * (nb - b), new, nb
    return Model({int(i): float(c) for i, c in zip(chosen, w, strict=True) if c}, b)


def mention_gap(model: Model, texts: list[str], groups: tuple[tuple[str, ...], ...] = IDENTITY) -> float:
    """The largest change of a text's score when one of the terms is put in: what naming a group does by itself."""
    scorer = Scorer(model)
    plain = scorer.scores(texts)
    return max((float(np.abs(scorer.scores([f"{t} {term}" for t in texts]) - plain).max()) for term in sorted({w for g in groups for w in g}) if texts), default=0.0)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, groups: tuple[tuple[str, ...], ...] = IDENTITY, **how) -> Model:
    """Train on whole texts of at most ``per_class`` labelled ids of each class that aren't held out, picked by a hash of the id.

    A null label is none; of several labels of an id the highest counts, of several texts of an id one stays, by its hash. So at
    most ``per_class`` rows of a class are collected, however often ids and rows repeat; the pick is cut to that number before
    it is broadcast. ``groups`` are the identity terms of the counterfactuals.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out("doc_id"))
    marks = marks.groupBy("doc_id").agg(F.least(F.lit(1), F.greatest(F.lit(0), F.max("y"))).alias("y"))
    spread = 1 << 20
    marks = marks.withColumn("key", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(spread)))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = lambda y: int(min(1.0, per_class / max(1, counts.get(y, 0))) * spread)
    marks = marks.filter(F.col("key") < F.when(F.col("y") == 1, F.lit(rate(1))).otherwise(F.lit(rate(0))))
    nth = F.row_number().over(W.partitionBy("y").orderBy("key", "doc_id"))  # a task passes on ``per_class`` ids of a class at most
    marks = marks.withColumn("nth", nth).filter(F.col("nth") <= per_class).select("doc_id", "y")
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")  # 2 * per_class rows at most
    picked = found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    packed = lambda buckets: np.array(buckets, "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(2)):
                words = [types_of(t) for t in part]
                pairs = [counterfactuals(ws, groups) for ws in words]
                changed = [[packed(come) + packed(go) for come, go in own] for own in pairs]
                lengths = [[len(come) * 4 for come, _ in own] for own in pairs]
                ids = [packed([b for w in sorted(ws) for b in buckets_of(w)]) for ws in words]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in range(2)), pa.array(ids, pa.binary()), pa.array(changed, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))], names=["doc_id", "y", "ids", "changed", "come"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    found = sorted(picked.mapInArrow(tidy(run), f"doc_id {kind}, y int, ids binary, changed array<binary>, come array<int>").collect(), key=lambda r: (str(r["doc_id"]), r["ids"]))
    changes: Counter[tuple[bytes, bytes]] = Counter((c[:n], c[n:]) for r in found for c, n in zip(map(bytes, r["changed"]), r["come"], strict=True))
    rows = [(r["y"], np.frombuffer(r["ids"], "<i4")) for r in found]
    del found
    return train(rows, changes, **how)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted. Whole texts, however long, where they are read: no shuffle.

    A null or empty text scores as the bias alone; equal texts score alike, and repeated rows and null ids stay rows.
    Further columns, whatever their names, are ignored; no rows give none. A score of exactly 0.5 is predicted 1.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # at most ``most_features`` weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(scorer.scores(part), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select(F.col("doc_id").alias(id_col), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
