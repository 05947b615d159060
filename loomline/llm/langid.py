"""Language ID in two levels: one-versus-one linear support vector machines between language families, then
one-versus-one machines between the languages of the family found.

Features are hashed letter triples (whatever isn't a letter counts as a space), averaged over the text, so a score
costs one table look-up per letter and machine, and texts of any length compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import held_out, ship, tidy
from .pieces import slices

#: Families by language code; codes in none are joined by likeness where there are many.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "fa"),
}
UNKNOWN = "und"
BUCKETS = 1 << 14
PART = 1 << 11  # buckets that are spread out at once in training

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x10000)])
    return _letters


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each triple that is centred on a letter, number of those of each text)."""
    joined = "\n".join(["", *[t.lower() for t in texts], ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    table = letter_table()
    is_letter = table[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        seen, back = np.unique(codes[high], return_inverse=True)
        is_letter[high] = np.array([chr(c).isalpha() for c in seen])[back]
    sizes = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) + 1
    codes[~is_letter] = 32
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    centre = is_letter[1:-1]
    before = np.concatenate([[0], np.cumsum(centre)])
    counts = before[np.minimum(ends - 1, len(centre))] - before[np.minimum(ends - sizes - 1, len(centre))]
    return (h & np.uint32(BUCKETS - 1))[centre].astype(np.int32), counts


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    family: dict[str, str] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # (level, a, b): "" for families, else the family
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each text under each machine, number of letters)."""
        ids, counts = triples(texts)
        out = np.zeros((len(texts), self.weights.shape[1]))
        some = np.flatnonzero(counts)
        if len(some) and out.shape[1]:
            starts = (np.cumsum(counts) - counts)[some]
            for j in range(out.shape[1]):
                out[some, j] = np.add.reduceat(self.weights[:, j][ids], starts, dtype=np.float64) / counts[some]
        return out + self.bias, counts

    def _winners(self, names: list[str], level: str, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most duels won, ties to the larger sum of margins; and the least margin of the winner's duels."""
        if len(names) == 1:
            return np.zeros(len(margins), int), np.full(len(margins), 9.0)
        won, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), 9.0)
        for j, (lv, a, b) in enumerate(self.pairs):
            if lv == level:
                for name, m in ((a, margins[:, j]), (b, -margins[:, j])):
                    i = names.index(name)
                    won[:, i] += (m > 0) + np.tanh(m) * 1e-3
                    least[:, i] = np.minimum(least[:, i], m)
        best = won.argmax(axis=1)
        return best, least[np.arange(len(best)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins, counts = self.margins(texts)
        names = sorted(set(self.family.values()))
        fam, sure = self._winners(names, "", margins)
        sure = 1 / (1 + np.exp(-4 * sure))
        out = np.full(len(texts), UNKNOWN, object)
        for i, name in enumerate(names):
            rows = np.flatnonzero(fam == i)
            own = sorted(x for x in self.langs if self.family[x] == name)
            best, least = self._winners(own, name, margins[rows])
            out[rows] = np.array(own, object)[best]
            sure[rows] *= 1 / (1 + np.exp(-4 * least))
        out[counts == 0] = UNKNOWN
        sure[counts == 0] = 0.0
        return out.tolist(), sure


def machine(gram: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by accelerated gradient steps; both classes weigh alike.

    ``gram`` holds the inner products of the rows, plus 1 for the bias. Every step stays in the span of the rows, so the
    result is their coefficients: no copy of the rows is made, however many features they have.
    """
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v, top = np.ones(len(y), np.float32), 1.0
    for _ in range(12):  # largest curvature, for the step
        v = np.sqrt(c) * (gram @ (np.sqrt(c) * v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = np.float32(1 / (2.2 * top + decay))
    w = z = np.zeros(len(y), np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (gram @ z))
        new = z - step * (np.float32(decay) * z - 2 * c * y * slack)
        z, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def families(langs: list[str], profiles: np.ndarray, most: int = 12) -> dict[str, str]:
    """Family of each language: by the table; codes that it lacks are joined by likeness, to families of at most ``most``.

    So the number of machines stays near the number of languages times ``most``, whatever the labels are called.
    """
    table = {lang: name for name, own in FAMILIES.items() for lang in own}
    out = {lang: table[lang] for lang in langs if lang in table}
    rest = [i for i, lang in enumerate(langs) if lang not in table]
    p = profiles / np.maximum(1e-12, np.linalg.norm(profiles, axis=1, keepdims=True))
    while rest:
        near = np.argsort(-(p[rest] @ p[rest[0]]), kind="stable")[:most] if len(rest) > most else np.arange(len(rest))
        near = np.union1d(near, [0])[:most]
        own = [rest[i] for i in near.tolist()]
        # few unknown codes are families of their own, as nothing is known to join them
        out |= {langs[i]: langs[i] if len(langs) <= most else f"~{langs[own[0]]}" for i in own}
        rest = [i for i in rest if i not in own]
    return out


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], per_machine: int = 600) -> Model:
    """A model from (language, buckets, their shares), which stay sparse. A machine learns from ``per_machine`` rows of either side, drawn evenly."""
    langs = sorted({s[0] for s in samples})
    if not langs:
        return Model()
    of = np.array([s[0] for s in samples])
    mean = np.zeros(BUCKETS)
    profiles = np.zeros((len(langs), BUCKETS), np.float32)
    for lang, ids, shares in samples:
        mean[ids] += shares
        profiles[langs.index(lang), ids] += shares
    scale = (1 / np.sqrt(mean / len(samples) + 1e-5)).astype(np.float32)
    family = families(langs, profiles * scale)
    del profiles
    fam = np.array([family[lang] for lang in of])
    pairs = [("", a, b) for a, b in combinations(sorted(set(family.values())), 2)]
    for name in sorted(set(family.values())):
        pairs += [(name, a, b) for a, b in combinations([lang for lang in langs if family[lang] == name], 2)]
    weights, bias = np.zeros((BUCKETS, len(pairs)), np.float32), np.zeros(len(pairs), np.float32)
    for j, (level, a, b) in enumerate(pairs):
        names = of if level else fam
        rows = np.concatenate([own[np.unique(np.linspace(0, len(own) - 1, min(len(own), per_machine)).astype(int))] for own in (np.flatnonzero(names == x) for x in (a, b))])
        gram = np.ones((len(rows), len(rows)), np.float32)
        x = np.zeros((len(rows), PART), np.float32)
        for lo in range(0, BUCKETS, PART):
            x[:] = 0
            for i, r in enumerate(rows.tolist()):
                _, ids, shares = samples[r]
                p, q = np.searchsorted(ids, (lo, lo + PART))
                x[i, ids[p:q] - lo] = shares[p:q]
            x *= scale[lo : lo + PART]
            gram += x @ x.T
        w = machine(gram, np.where(names[rows] == a, 1.0, -1.0).astype(np.float32))
        bias[j] = w.sum()
        for c, r in zip(w, rows.tolist(), strict=True):
            weights[samples[r][1], j] += c * samples[r][2]
        weights[:, j] *= scale * scale
    return Model(langs, family, pairs, weights, bias)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, rows_at_most: int = 6000) -> Model:
    """Train on whole texts of at most ``per_language`` labelled rows that aren't held out, picked by a hash of id and text.

    Every language is learnt; with many of them, each has fewer rows, so that about ``rows_at_most`` are picked in all (but
    20 of each). Rows that repeat id and text count once, of others with the same id each may be picked. Different rows are
    counted over all rows first (approximately, for the pick only) and each language is cut to its number before anything is
    collected: what reaches the driver are the bucket shares of at most so many rows, 4 and 4 bytes for each bucket that a
    text has, however large the table is and however often a row repeats.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out("doc_id"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text", F.lit(7)).bitwiseAND(F.lit((1 << 62) - 1)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}  # a row per language
    if not counts:
        return Model()
    each = min(per_language, max(20, rows_at_most // len(counts)))
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, 1.5 * each / max(1, n)) * (1 << 62)))])
    picked = rows.filter(F.col("key") <= limits[F.col("lang")]).dropDuplicates(["lang", "key"])
    nth = F.row_number().over(W.partitionBy("lang").orderBy("key"))  # a task passes on ``each`` rows of a language at most
    picked = picked.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "key", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(3)):
                ids, counts = triples(part)
                out, lo = [], 0
                for n in counts:
                    own, c = np.unique(ids[lo : lo + n], return_counts=True)
                    out.append((own.astype("<i4").tobytes(), (c / max(1, n)).astype("<f4").tobytes()))
                    lo += n
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in range(3)), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["lang", "key", "doc_id", "ids", "shares"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = sorted(picked.mapInArrow(tidy(run), f"lang string, key long, doc_id {kind}, ids binary, shares binary").collect(), key=lambda r: (r["lang"], r["key"], str(r["doc_id"]), r["ids"]))
    samples = [(r["lang"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in found if len(r["ids"])]
    del found
    return train(samples)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` in a struct ``row``, with lang_pred and score; a text without letters, empty or null is ``und`` with score 0.

    Whole texts, where they are read: no shuffle. Only the text is looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # a row of weights per bucket, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                lang, score = sent.value.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score. Trains on the rows that aren't held out; without any, all are ``und``."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **how)
    out = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "text"), model)
    return out.select(F.col("row.doc_id").alias(id_col), "row.held_out", "lang_pred", "score")
