"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one valid encoding, so its last token is unique: the token ending there whose start
is a prefix that ends in a token it is compatible with. Tokens that end at a place come from an automaton over the
vocabulary, longest first; two tokens are compatible if byte-pair merging of their joint bytes gives back the two.
Back-pointers from the end spell the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .pieces import PieceCache, assumed, slices

NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable bytes stand for themselves, the others follow from code point 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file (tokenizers library JSON)."""

    def __init__(self, path: str):
        spec = assumed(path)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s).decode("latin-1")
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text = {i: s for s, i in ids.items()}  # bytes of each id, as latin-1
        self.bytes = {i: s.encode("latin-1") for i, s in self.text.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = ids[a], ids[b]
            self.rank[pair] = r
            parts.setdefault(ids[a + b], (r, *pair))
        self._spines(parts)
        self._compatible: dict[int, bool] = {}
        self.ids = self._reachable(ids, parts)
        self._build_automaton()

    def _spines(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """For each token what stands at its right (left) edge while it is merged: (token, rank of the merge that ends it), first to last."""
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for t in sorted(self.text, key=lambda t: parts[t][0] if t in parts else -1):
            if t in parts:
                r, a, b = parts[t]
                self.right[t] = [*self.right[b][:-1], (b, r), (t, NEVER)]
                self.left[t] = [*self.left[a][:-1], (a, r), (t, NEVER)]
            else:
                self.right[t] = self.left[t] = [(t, NEVER)]

    def _apart(self, a: int, b: int, ends: int = NEVER) -> bool:
        """True if no merge before rank ``ends`` joins the right edge of a with the left edge of b while both are built."""
        xs, ys, i, j, rank = self.right[a], self.left[b], 0, 0, self.rank
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = rank.get((x, y))
            # of equal ranks the place further left merges first: b's own merge lies right of the border, a's left of it
            if r is not None and r < x_ends and r <= y_ends and r < ends:
                return False
            if x_ends <= y_ends:
                if x_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _reachable(self, ids: dict[str, int], parts: dict[int, tuple[int, int, int]]) -> dict[str, int]:
        """The tokens that merging their own bytes makes."""
        good: dict[int, bool] = {}
        for t in sorted(self.text, key=lambda t: parts[t][0] if t in parts else -1):
            if t in parts:
                r, a, b = parts[t]
                good[t] = good[a] and good[b] and self._apart(a, b, r)
            else:
                good[t] = len(self.text[t]) == 1
        return {s: i for s, i in ids.items() if good[i]}

    def _build_automaton(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 250_000:
                self._compatible.clear()
            known = self._compatible[key] = self._apart(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece: linear in its length, however long it is."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        last, size, done = [0] * len(s), [0] * len(s), -1
        compatible = self.compatible
        for end, (t, n) in self.automaton.iter(s):
            if end == done:
                continue
            start = end - n
            if start < 0 or (size[start] and compatible(last[start], t)):
                last[end], size[end], done = t, n, end
        out, at = [], len(s) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_OPEN: dict[str, tuple[Vocabulary, PieceCache, dict[str, bytes]]] = {}


def opened(path: str) -> tuple[Vocabulary, PieceCache, dict[str, bytes]]:
    """The vocabulary, a cache from pieces to decimal ids joined by commas, and the bytes of each decimal id; once per worker."""
    if path not in _OPEN:
        v = Vocabulary(path)
        cache = PieceCache(lambda p: ",".join(map(str, v.encode_piece(p))), {s: str(i) for s, i in v.special.items()})
        _OPEN[path] = v, cache, {str(i): b for i, b in v.bytes.items()}
    return _OPEN[path]


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids as array<int>.

    Encodes whole texts (a null text is an empty one: no ids, hashes of nothing) and decodes the ids again. Rows with
    null or repeated ids stay rows of their own; further columns are ignored. Rows stay where they are read: no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache, spelled = opened(vocabulary)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                n, ids_sha, text_sha, ids = [], [], [], []
                for text in part:
                    joined = ",".join(cache.text(text))
                    each = joined.split(",") if joined else []
                    n.append(len(each))
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded = b"".join(map(spelled.__getitem__, each)).decode("utf-8", "replace")
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        ids.append(list(map(int, each)))
                cols = [batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)
