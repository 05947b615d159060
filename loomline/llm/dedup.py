"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with the same set of shingles are one class from the start. Each class is posted under its (coordinate, value)
pairs, 64 bits each. A pair of classes must collide in at least ``t`` coordinates; so values that occur once are dropped,
classes with fewer than t others too, and of the rest only the rarest count-t+1 are merged (prefix), which skips the long
lists of frequent values; of lists with the same members one is merged. Every list elects its most central class and its
members meet that one: collisions are counted per pair, pairs above the threshold are confirmed on full sets of shingles,
and what is tied is one component. In lists that still hold several components the exact rest follows: classes of different
components meet in blocks of bounded size, where collisions are counted per pair again (each pair in one list only); the
classes with a pair above the threshold meet on full sets, whose intersections are counted by matrix products, and only
edges that tie components leave a block. So no list of pairs of a group is ever made, none is lost, and sets travel only
where a count of collisions asks for them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ship, tidy, written
from .components import connected
from .pieces import slices

WORDS = 5
COORDINATES = 64
MOST_BROADCAST = 100_000  # rows of a few words; beyond, the join shuffles
BLOCK = 1024  # classes
BLOCK_GRAMS = 2_000_000
CHUNK = 2048  # shingles that are counted at once
LONG_WORD = 64  # bytes
RUN_BYTES = 500_000  # of texts hashed at once: each byte takes about a hundred in arrays

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)
_MIX = _rng.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(similarity: float, coordinates: int = COORDINATES, risk: float = 1e-6) -> int:
    """The largest number of collisions that a pair of that similarity misses with at most that risk."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > risk:
            return max(1, t)
    return coordinates


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word in lower-cased bytes: a polynomial of its bytes by running sums, then mixed with its length; long words by a digest."""
    global _powers
    if len(_powers) <= len(data):
        n = max(len(data) + 1, 2 * RUN_BYTES)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _PRIME)]), dtype=np.uint64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    size = (ends - starts).astype(np.uint64)
    # the sum runs from the end of the text so that a word's own powers follow from its end
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], dtype=np.uint64)])
    own = (sums[ends] - sums[starts]) * _powers[len(data) - starts]
    # all words are scaled by the same power of the text's length; it is undone to make hashes independent of place
    inverse = pow(int(_powers[len(data)]), -1, 1 << 64)
    out = _mixed(own * np.uint64(inverse) + size * _MIX[15])
    for i in np.flatnonzero(size > LONG_WORD).tolist():  # polynomials mod 2**64 fail for some texts of a thousand letters
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return starts, out


def gram_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``words`` words, or of all if there are fewer; empty without words."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    starts, h = word_hashes(data)
    first = np.searchsorted(starts, at)  # number of the first word of each text
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words if len(rolled) else 0):
        rolled += h[k : len(h) - words + 1 + k] * _MIX[k]
    rolled = _mixed(rolled)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            g = np.sort(rolled[a : b - words + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(_mixed((h[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + (b - a).astype(np.uint64) * _MIX[14:15]))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, coordinates) of the least hash under each coordinate's permutation. Sets must not be empty.

    The minimum of a large set has many leading zeros; all its 64 bits are mixed, together with the coordinate, so that
    unrelated sets of any size share a value with a probability of 2**-64, and values of different coordinates differ.
    """
    out = np.empty((len(sets), COORDINATES), np.uint64)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for j in range(COORDINATES):
            out[:, j] = _mixed(np.minimum.reduceat(flat * _MUL[j] + _ADD[j], starts) + _ADD[j : j + 1] * _MIX[13:14])
    return out


def set_name(grams: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sets(rows: DataFrame, words: int, signed: bool) -> DataFrame:
    """(id, text_key, n, h1, h2) with the signature, or else with the shingles; h1 and h2 are the halves of the set's name, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(2), RUN_BYTES):
                sets = gram_sets(part, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                names = np.zeros((len(sets), 2), np.int64)
                for i in full:
                    names[i] = np.frombuffer(set_name(sets[i]), "<i8")
                empty = np.array([not len(s) for s in sets])
                cols = [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(names[:, k], pa.int64(), mask=empty) for k in (0, 1))]
                if signed:
                    sig = np.zeros((len(sets), COORDINATES), np.uint64)
                    sig[full] = signatures([sets[i] for i in full])
                    last = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()))
                else:
                    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                    last = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*cols, last], names=["id", "text_key", "n", "h1", "h2", "sig" if signed else "grams"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, text_key long, n long, h1 long, h2 long, " + ("sig" if signed else "grams") + " array<long>")


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def tie(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _incidence(flat: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(rows, own) with 1 where a row's list has the value. ``own`` is sorted; flat holds the rows' lists."""
    at = np.searchsorted(own, flat)
    hit = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == flat)
    out = np.zeros((len(lengths), len(own)), np.float32)
    out[np.repeat(np.arange(len(lengths)), lengths)[hit], at[hit]] = 1
    return out


def _shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many values each row of a shares with each row of b; both are (flat, lengths) without repeats in a row."""
    both, out = np.intersect1d(a[0], b[0]), np.zeros((len(a[1]), len(b[1])), np.float32)
    for lo in range(0, len(both), CHUNK):
        out += _incidence(*a, both[lo : lo + CHUNK]) @ _incidence(*b, both[lo : lo + CHUNK]).T
    return out


def _sides(both: pa.Table) -> tuple[pa.Table, pa.Table]:
    side = np.asarray(both["side"])
    return both.filter(pa.array(side == 0)), both.filter(pa.array(side == 1))


def _suspects(t: int):
    def meet(both: pa.Table) -> pa.Table:
        """Classes of two blocks of a list with at least ``t`` collisions with a class of another component, if this list is the first that both are in."""
        k, side, node = [], [], []
        left, right = _sides(both)
        if left.num_rows:
            alone, of = not right.num_rows, left["token"][0].as_py()  # a block without another meets itself
            (na, ca, sa, la), (nb, cb, sb, lb) = ((np.asarray(x["node"]), np.asarray(x["component"]), np.asarray(x["sig"].combine_chunks().flatten()).reshape(x.num_rows, -1), x["lists"]) for x in (left, left if alone else right))
            same = np.zeros((len(na), len(nb)), np.uint8)
            for j in range(sa.shape[1]):
                same += sa[:, j, None] == sb[None, :, j]
            met = (same >= t) & ((ca[:, None] < cb[None, :]) if alone else (ca[:, None] != cb[None, :]))
            i, j = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
            if len(i):
                earlier = []
                for lists, rows in ((la, i), (lb, j)):
                    own = lists.combine_chunks().take(pa.array(rows))
                    flat, ends = np.asarray(own.flatten()), np.cumsum(np.asarray(own.value_lengths(), np.int64))
                    before = np.concatenate([[0], np.cumsum(flat < of)])[np.concatenate([[0], ends])]
                    earlier.append((flat[flat < of], np.diff(before)))
                met = met[np.ix_(i, j)] & (_shared(*earlier) == 0)
                for s, own in ((0, na[i[met.any(axis=1)]]), (1, nb[j[met.any(axis=0)]])):
                    node += own.tolist()
                    side += [s] * len(own)
                k = [left["k"][0].as_py()] * len(node)
        return pa.table({"k": pa.array(k, pa.int64()), "side": pa.array(side, pa.int32()), "node": pa.array(node, pa.int64())})

    return meet


def _meet(percent: int):
    def meet(both: pa.Table) -> pa.Table:
        """Ties (a, b) of components between two blocks: exact intersections, counted over the shingles that both sides have."""
        forest, ties_a, ties_b = _Forest(), [], []
        left, right = _sides(both)
        if left.num_rows and right.num_rows:
            (ca, fa, la), (cb, fb, lb) = ((np.asarray(x["component"]), np.asarray(x["grams"].combine_chunks().flatten()), np.asarray(x["grams"].combine_chunks().value_lengths(), np.int64)) for x in (left, right))
            inter = _shared((fa, la), (fb, lb))
            inter = np.rint(inter).astype(np.int64)
            i, j = np.nonzero((100 * inter >= percent * (la[:, None] + lb[None, :] - inter)) & (ca[:, None] != cb[None, :]))
            for a, b in sorted(set(zip(ca[i].tolist(), cb[j].tolist(), strict=True))):
                if forest.tie(a, b):
                    ties_a.append(a)
                    ties_b.append(b)
        return pa.table({"a": pa.array(ties_a, pa.int64()), "b": pa.array(ties_b, pa.int64())})

    return meet


def _small(table: DataFrame) -> DataFrame:
    """A written table, sent whole if its rows are few enough; else the join shuffles."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _duels(lists: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(k, side, token, node, component, sig, lists): the blocks of the lists that hold several components, once for each meeting k with another block or itself."""
    member = written(lists.join(nodes.select("node", "n", "component"), "node").select("token", "node", "n", "component"), "dedup-members", n)
    by_part = member.groupBy("token", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    alone = F.col("c") >= BLOCK  # such a component fills blocks of its own; the smaller ones of a list share blocks
    opened = member.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("token")
    parts = written(by_part.join(opened, "token"), "dedup-parts", n)
    mixed = parts.groupBy("token").agg(F.sum(F.when(~alone, F.col("c"))).alias("mc"), F.sum(F.when(~alone, F.col("s"))).alias("ms"))
    blocks_of = lambda c, s: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(s / BLOCK_GRAMS)).cast("int")
    shape = parts.join(mixed, "token").select("token", "component", F.when(alone, F.col("component")).alias("only"), F.when(alone, blocks_of(F.col("c"), F.col("s"))).otherwise(blocks_of(F.col("mc"), F.col("ms"))).alias("blocks"))
    block = F.struct("only", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("nth"))
    dealt = written(member.join(shape, ["token", "component"]).select("token", "node", block.alias("block")), "dedup-blocks", n)
    blocks = dealt.select("token", "block").distinct()
    same = F.coalesce(F.col("x.only") == F.col("y.only"), F.lit(False))
    duels = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "token").filter((F.col("x") <= F.col("y")) & ~same)
    one, other = (F.struct(F.col(c).alias("block"), F.lit(i).alias("side")) for i, c in enumerate("xy"))
    duels = duels.select("token", F.xxhash64("token", "x", "y").alias("k"), F.explode(F.when(F.col("x") == F.col("y"), F.array(one)).otherwise(F.array(one, other))).alias("z"))
    met = dealt.join(duels.select("token", "k", "z.block", "z.side"), ["token", "block"]).select("k", "side", "token", "node")
    return met.join(nodes.select("node", "component", "sig", "lists"), "node")


def _components(classes: DataFrame, shingles, percent: int, risk: float, n: int) -> DataFrame | None:
    """(node, component) of the classes with a candidate, by all links of at least ``percent``; None if there is no candidate. ``n`` bounds the classes."""
    t = match_threshold(percent / 100, risk=risk)
    prefix = COORDINATES - t + 1
    posted = classes.select("node", F.explode("sig").alias("token"))
    often = written(posted.groupBy("token").agg(F.count("*").alias("freq")).filter("freq >= 2"), "dedup-values", n * COORDINATES // 2)
    held = posted.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"), F.sum("freq").alias("central"))  # at most COORDINATES a class
    merged = held.filter(F.size("tokens") >= t).select("node", "central", F.explode(F.expr(f"slice(tokens, 1, size(tokens) - {t - 1})")).alias("x")).select("node", "central", "x.token")
    merged = written(merged, "dedup-merged", n * prefix)
    name = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]  # of the members
    heads = merged.groupBy("token").agg(F.count("*").alias("n"), *name, F.max(F.struct("central", "node")).alias("head")).filter("n >= 2")
    heads = heads.groupBy("n", "x0", "x1").agg(F.min("token").alias("token"), F.first("head.node").alias("head"))
    n_merged = merged.count()
    lists = written(merged.join(heads.select("token", "head"), "token").select("token", "node", "head"), "dedup-lists", n_merged)
    nodes = lists.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("lists"))  # at most COORDINATES a class
    nodes = written(nodes.join(classes.select("node", "sig", "n"), "node"), "dedup-nodes", min(n, n_merged), 25_000)
    n_nodes = nodes.count()
    if not n_nodes:
        return None

    grams = shingles(nodes.select("node"), n_nodes)
    pairs = lists.filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    side = lambda table, own, *cols: table.select(F.col("node").alias(own), *[F.col(c).alias(own + c) for c in cols])
    small, large = F.least("an", "bn"), F.greatest("an", "bn")
    collisions = F.aggregate(F.zip_with("asig", "bsig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    counted = pairs.join(side(nodes, "a", "sig", "n"), "a").join(side(nodes, "b", "sig", "n"), "b").filter((F.lit(100) * small >= F.lit(percent) * large) & (collisions >= t)).select("a", "b")
    sets = counted.join(side(grams, "a", "grams"), "a").join(side(grams, "b", "grams"), "b")
    confirmed = sets.withColumn("i", F.size(F.array_intersect("agrams", "bgrams"))).filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("agrams") + F.size("bgrams") - F.col("i"))).select("a", "b")
    nodes = nodes.join(connected(confirmed, n_merged), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = written(nodes, "dedup-components", n_nodes, 25_000)

    suspects = _duels(lists, nodes, n_merged).groupBy("k", "token").applyInArrow(_suspects(t), "k long, side int, node long")
    full = suspects.join(nodes.select("node", "component"), "node").join(grams, "node").select("k", "side", "component", "grams")
    ties = connected(full.groupBy("k").applyInArrow(_meet(percent), "a long, b long"))
    ties = ties.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return written(nodes.select("node", "component").join(ties, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "dedup-tied", n_nodes)


def near_duplicates(docs: DataFrame, *, percent: int = 80, words: int = WORDS, risk: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Texts are lower-cased A to Z and cut into words at blanks and control blanks; a document's set are its distinct
    shingles of ``words`` words, all its words as one if there are fewer, nothing without words or text. Documents are
    linked if 100 * intersection >= percent * union; a link is missed with a probability of ``risk`` at most, and only if
    nothing else ties its ends. component_id is the least id of the linked documents, nulls aside; a document without
    words is its own. Repeated rows and ids are rows of their own in one component. With ``keys``, also text_key (a hash
    of the text), and first: true for the one row of a component that has its least (id, text_key), and for rows
    without words. No rows give no rows; further columns are ignored. A text is hashed whole, however long.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signed = written(_sets(rows, words, True), "dedup-signed")
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "text_key")).alias("rep")
    classes = signed.filter("n > 0").groupBy("h1", "h2").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), least)
    n_rows = signed.count()
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "dedup-classes", n_rows, 25_000)  # numbers are fixed once written

    def shingles(nodes: DataFrame, n: int) -> DataFrame:
        """The full sets of some classes, from the texts once more: storing those of all documents would take more room than the texts."""
        wanted = classes.join(nodes, "node", "left_semi").select("node", "h1", "h2", F.col("rep.id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
        wanted = written(wanted, "dedup-wanted", n)
        wanted = F.broadcast(wanted) if n <= MOST_BROADCAST else wanted
        again = _sets(rows, words, False).drop("n").join(wanted, ["h1", "h2"]).filter(F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")))
        return written(again.select("node", "grams").dropDuplicates(["node"]), "dedup-sets", n, 20_000)

    parts = _components(classes, shingles, percent, risk, n_rows)
    name = classes.select("node", "h1", "h2", "rep")
    if parts is not None:
        heads = name.join(parts, "node").groupBy("component").agg(F.min("rep").alias("head"))
        tied = parts.join(heads, "component").select("node", "head")
        name = name.join(tied, "node", "left").select("h1", "h2", F.coalesce("head", "rep").alias("rep"))
    name = name.select("h1", "h2", "rep")
    rows = signed.select("id", "text_key", "n", "h1", "h2")
    blank = rows.filter("n = 0").select("id", "text_key", "n", F.col("id").alias("own"), F.lit(True).alias("first"))
    first = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("text_key") == F.col("rep.text_key"))
    out = rows.filter("n > 0").join(name, ["h1", "h2"]).select("id", "text_key", "n", F.col("rep.id").alias("own"), first.alias("first")).unionByName(blank)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("own").alias("component_id"), F.col("id").eqNullSafe(F.col("own")).alias("kept"), *(["text_key", "first"] if keys else []))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component; rows without words stay. All columns are kept, whatever their names.

    What goes is decided on ids and hashes of texts; texts are read where they are and shuffled only where these
    decisions are too many to be sent whole. Of whole repeated rows (same id and text) one stays.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, keys=True, **how).filter("n_shingles > 0")
    found = written(found.groupBy(F.col(f"`{id_col}`").alias("id"), F.col("text_key").alias("key")).agg(F.max("first").alias("first"), F.count("*").alias("times")).filter(~F.col("first") | (F.col("times") > 1)), "dedup-gone")
    gone, again = found.filter(~F.col("first")).select("id", "key"), found.filter("first").select("id", "key")
    blank = ~F.coalesce(F.regexp_like(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("rid"), F.when(~blank, F.xxhash64(F.col(f"`{text_col}`"))).alias("rkey"))
    same = F.col("rid").eqNullSafe(F.col("id")) & (F.col("rkey") == F.col("key"))
    rows = rows.join(_small(gone), same, "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    one = rows.join(_small(again), same, "left_semi").groupBy("rid", "rkey").agg(F.first("row").alias("row"))  # partial before the shuffle: a row may be repeated often
    return rows.join(_small(again), same, "left_anti").select("row.*").unionAll(one.select("row.*"))
