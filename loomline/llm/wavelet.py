"""Wavelet matrix over token ids: one bit-plane per id bit, with rank and select.

Ids that share their high bits lie together in the lower planes, so access, counting and finding occurrences take one
step per bit. A file holds, in this order: magic, number of planes, ids and zeros of each plane; the ranks before every
``STEP`` bits of all planes; the sizes of all pieces; and the planes, most significant first, in pieces of ``PIECE`` bytes
that are compressed one by one. So a look-up reads the ranks and unpacks one piece per plane, not the planes.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM2"
STEP = 4096  # bits between stored ranks
PIECE = 1 << 16  # bytes of a plane that are compressed together; a multiple of STEP bits


class Plane:
    """Packed bits in pieces, which are unpacked when they are needed, with the number of ones before each ``STEP``."""

    def __init__(self, pieces: list[bytes], before: np.ndarray, n: int, zeros: int, raw: np.ndarray | None = None):
        self.pieces, self.before, self.n, self.zeros = pieces, before, n, zeros
        self._raw, self._open, self._ones = raw, {}, None

    @classmethod
    def of(cls, packed: np.ndarray, n: int) -> Plane:
        ones = np.bitwise_count(packed)
        pad = -len(ones) % (STEP // 8)
        before = np.concatenate([[0], np.cumsum(np.pad(ones, (0, pad)).reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))])
        return cls([], before, n, n - int(before[-1]), packed)

    def dumps(self, compressor: zstandard.ZstdCompressor) -> list[bytes]:
        return [compressor.compress(self._raw[lo : lo + PIECE].tobytes()) for lo in range(0, len(self._raw), PIECE)]

    def packed(self) -> np.ndarray:
        """All bits of the plane."""
        if self._raw is None:
            self._raw = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, self.pieces)), np.uint8)
        return self._raw

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi, which lie in one piece."""
        if self._raw is not None:
            return self._raw[lo:hi]
        i = lo // PIECE
        if i not in self._open:
            self._open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.pieces[i]), np.uint8)
        return self._open[i][lo - i * PIECE : hi - i * PIECE]

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed(), count=self.n).view(bool)

    def get(self, i: int) -> int:
        return int(self.part(i >> 3, (i >> 3) + 1)[0] >> (7 - (i & 7)) & 1)

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        b = i // STEP
        lo = b * STEP // 8
        if i == b * STEP:
            return int(self.before[b])
        own = self.part(lo, (i + 7) >> 3)
        out = int(self.before[b]) + int(np.bitwise_count(own[: (i >> 3) - lo]).sum())
        return out + (int(np.bitwise_count(own[(i >> 3) - lo] >> (8 - (i & 7)))) if i & 7 else 0)

    def ranks1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of many places."""
        if self._ones is None:
            self._ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed()), dtype=np.uint32)]).astype(np.int64)
        return self._ones[at >> 3] + np.bitwise_count(self.packed()[np.minimum(at >> 3, len(self.packed()) - 1)].astype(np.uint16) >> (8 - (at & 7)).astype(np.uint16))

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        steps = self.before if bit else np.minimum(np.arange(len(self.before)) * STEP, self.n) - self.before
        b = int(np.searchsorted(steps, k, side="right")) - 1
        lo = b * STEP
        part = np.unpackbits(self.part(lo // 8, min((lo + STEP) // 8, (self.n + 7) // 8)), count=min(STEP, self.n - lo))
        return lo + int(np.flatnonzero(part == bit)[k - int(steps[b])])


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        cur = np.asarray(ids, np.uint16 if bits <= 16 else np.uint32)
        if len(ids) and int(np.max(ids)) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        planes = []
        for level in range(bits - 1, -1, -1):
            bit = (cur >> cur.dtype.type(level) & cur.dtype.type(1)).view(cur.dtype).astype(bool)
            planes.append(Plane.of(np.packbits(bit), len(cur)))
            cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])  # far faster than a boolean index
        return cls(planes, len(cur))

    def dumps(self, level: int = 1) -> bytes:
        compressor = zstandard.ZstdCompressor(level=level)
        head = MAGIC + struct.pack("<QQ", len(self.planes), self.n) + b"".join(struct.pack("<Q", p.zeros) for p in self.planes)
        pieces = [p.dumps(compressor) for p in self.planes]
        ranks = np.concatenate([p.before for p in self.planes] or [np.zeros(0)]).astype("<u4").tobytes()
        sizes = np.array([len(x) for own in pieces for x in own], "<u4").tobytes()
        return b"".join([head, ranks, sizes, *(x for own in pieces for x in own)])

    @classmethod
    def loads(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        view = memoryview(data)
        bits, n = struct.unpack("<QQ", view[4:20])
        zeros = struct.unpack(f"<{bits}Q", view[20 : 20 + 8 * bits])
        at, steps, parts = 20 + 8 * bits, -(-n // STEP) + 1, -(-((n + 7) // 8) // PIECE)
        ranks = np.frombuffer(view, "<u4", bits * steps, at).reshape(bits, steps).astype(np.int64)
        at += 4 * bits * steps
        sizes = np.frombuffer(view, "<u4", bits * parts, at).astype(np.int64)
        ends = at + 4 * bits * parts + np.concatenate([[0], np.cumsum(sizes)])
        return cls([Plane([view[ends[j] : ends[j + 1]] for j in range(i * parts, (i + 1) * parts)], ranks[i], n, zeros[i]) for i in range(bits)], n)

    def all(self) -> np.ndarray:
        """Every id in order: the planes' partitions are undone from the last to the first."""
        cur = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            bit, out = plane.bits(), np.empty_like(cur)
            out[np.flatnonzero(~bit)] = cur[: plane.zeros]
            out[np.flatnonzero(bit)] = cur[plane.zeros :] | cur.dtype.type(1 << level)
            cur = out
        return cur

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at many places, one step per plane for all of them."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        if len(at) and not 0 <= int(at.min()) <= int(at.max()) < self.n:
            raise IndexError(at)
        for p in self.planes if len(at) else []:
            bit = p.packed()[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            ones = p.ranks1(at)
            at, out = np.where(bit == 1, p.zeros + ones, at - ones), out << np.uint32(1) | bit
        return out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in self.planes:
            b = p.get(i)
            out = out << 1 | b
            r = p.rank1(i)
            i = p.zeros + r if b else i - r
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level, p in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            a, b = p.rank1(lo), p.rank1(hi)
            lo, hi = (p.zeros + a, p.zeros + b) if token >> level & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences among the first i ids."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level, p in enumerate(reversed(self.planes)):
            at = p.select(1, at - p.zeros) if token >> level & 1 else p.select(0, at)
        return at

    def places(self, token: int) -> np.ndarray:
        """Places of all occurrences, ascending: the selects of all of them, plane by plane."""
        lo, hi = self._range(token, 0, self.n)
        at = np.arange(lo, hi)
        for level, p in enumerate(reversed(self.planes)) if hi > lo else ():
            one = token >> level & 1
            at = np.flatnonzero(p.bits() == bool(one))[at - p.zeros if one else at]
        return at
