"""Cutting texts into the pieces that a byte-level vocabulary encodes one by one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of byte-level vocabularies (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of \s there; Python's own \s also has the separators 1C to 1F.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
#: Letters and numbers below code point 256.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"

_any = regex.compile(PATTERN)
#: The same with the commonest branch first; only a quote can start the contractions, so the order among these is free.
_latin = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def cut(text: str) -> list[str]:
    """The pieces of a text. Texts below code point 256 take a pattern of plain character classes, which is twice as fast."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any.findall(text)
    return _latin.findall(text)


def assumed(path: str) -> dict:
    """The tokenizer file, if it says what ``cut`` and the caches take for granted; else an error, as ids would be wrong without a word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [name for name, bad in (
        ("a normalizer", spec.get("normalizer")),
        ("a pre-tokenizer other than ByteLevel with its pattern and without an added space", before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)),
        ("a model other than BPE", model.get("type", "BPE") != "BPE"),
        ("model options", any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))),
        ("added tokens that take spaces or whole words only", any(a.get(k) for a in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))),
    ) if bad]
    if wrong:
        raise ValueError(f"{path} has {', '.join(wrong)}")
    return spec


class PieceCache(dict):
    """What each piece becomes. Pieces over ``longest`` letters seldom come again and aren't kept.

    Memory stays bounded: with half of ``most`` pieces at hand these become the old ones and those before them go; an old
    piece that is met again is kept anew, so what is frequent stays.
    """

    def __init__(self, encode: Callable[[str], object], special: dict[str, object], most: int = 300_000, longest: int = 12):
        super().__init__()
        self.encode, self.special, self.most, self.longest, self.old = encode, special, most, longest, {}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            out = self.encode(piece)
        if len(piece) <= self.longest:
            self[piece] = out
        return out

    def turn(self) -> None:
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()

    def text(self, text: str) -> list:
        """What the pieces of a text become, in order."""
        self.turn()
        if self.split is not None and any(s in text for s in self.special):
            return [x for part in self.split.split(text) for x in ([self.special[part]] if part in self.special else map(self.__getitem__, cut(part)))]
        return list(map(self.__getitem__, cut(text)))


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of a column of texts (null: empty) of about ``most`` bytes, with the place of the first; only one run is in Python's memory at a time."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at, done = 0, 0
    while at < len(texts):
        end = min(len(texts), int(np.searchsorted(sizes, done + most)) + 1)
        yield at, [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at, done = end, int(sizes[end - 1])
