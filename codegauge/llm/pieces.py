"""A SentencePiece vocabulary as a unigram model, and texts as pre-tokens.

The model file is public and given by its path; it is read once on the driver (32,000 pieces, some hundred KB) and travels with the
task. Piece scores follow from the file's order by Zipf's law: score = -ln(rank + 1) - ln(H_n), rank 0 being the first normal piece;
no model is trained. A character without a piece costs the smallest score minus 10 and becomes its UTF-8 bytes, one byte piece each.

A text is escaped as SentencePiece does it with an identity normaliser: a mark U+2581 is put before it and replaces every blank.
No piece joins words across a mark, a line break or another character that no longer piece contains, so a text falls into
pre-tokens there and every segmentation of the text is one of each pre-token. A mark that the text itself contains is spelled in
bytes, so that decoding restores every text exactly.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Stands for a mark of the text itself: a surrogate, which no text can contain.
_OWN_MARK = "\ud800"
_UNKNOWN_COST = 10.0


def _fields(data: bytes) -> list[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol buffer message."""
    out, at = [], 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at:at + size], at + size
        out.append((key >> 3, value))
    return out


@dataclass
class Pieces:
    """Normal pieces with ids and scores, and the ids of the 256 byte pieces."""

    text: dict[str, tuple[int, float]]
    by_id: list[str]
    byte_ids: list[int]
    unknown: float
    longest: int
    joined: set[str]  # characters that stand in pieces of two and more characters

    @property
    def byte_of(self) -> dict[int, int]:
        return {i: b for b, i in enumerate(self.byte_ids)}


def load_pieces(path: str = MODEL_PATH) -> Pieces:
    with open(path, "rb") as file:
        entries = [dict(_fields(value)) for number, value in _fields(file.read()) if number == 1]
    names = [e[1].decode() for e in entries]
    normal = [k for k, e in enumerate(entries) if e.get(3, 1) == 1]
    harmonic = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    text = {names[k]: (k, -math.log(rank + 1) - harmonic) for rank, k in enumerate(normal)}
    byte_ids = [-1] * 256
    for k, e in enumerate(entries):
        if e.get(3, 1) == 6:
            byte_ids[int(names[k][3:5], 16)] = k
    return Pieces(text, names, byte_ids, min(s for _, s in text.values()) - _UNKNOWN_COST, max(map(len, text)),
                  {c for t in text if len(t) > 1 for c in t})


def splitter(pieces: Pieces) -> re.Pattern[str]:
    """Pre-tokens: marks with the joinable characters that follow, or one character that joins with none."""
    chars = "".join(sorted(pieces.joined - {MARK}))
    own = "".join(re.escape(c) for c in chars)
    return re.compile(f"{MARK}*[{own}]+|{MARK}+|[^{MARK}{own}]")


def escape(text: str) -> str:
    return (MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)) if text else ""


def char_bytes(char: str) -> bytes:
    return (MARK if char == _OWN_MARK else char).encode()


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of token ids; the inverse of every segmentation."""
    byte_of, out, run = pieces.byte_of, [], bytearray()
    for i in ids:
        if i in byte_of:
            run.append(byte_of[i])
            continue
        if run:
            out.append(run.decode(errors="replace").replace(MARK, _OWN_MARK))
            run = bytearray()
        out.append(pieces.by_id[i])
    out.append(run.decode(errors="replace").replace(MARK, _OWN_MARK))
    return "".join(out)[1:].replace(MARK, " ").replace(_OWN_MARK, MARK)


class Lookup:
    """Pieces by a hash of their characters, for many substrings at once."""

    _ODD, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x243F6A8885A308D3)

    def __init__(self, pieces: Pieces) -> None:
        names = list(pieces.text)
        flat, start = code_points(names)
        length, value = np.diff(start), self.start(len(names))
        for k in range(pieces.longest):
            some = np.flatnonzero(length > k)
            value[some] = self.extend(value[some], flat[start[some] + k].astype(np.uint64))
        hashes = value * self._ODD
        by = np.argsort(hashes)
        self.hashes = hashes[by]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.array([pieces.text[names[k]][0] for k in by], np.int64)
        self.scores = np.array([pieces.text[names[k]][1] for k in by])
        bits = 20
        self.table = np.searchsorted(self.hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        self.joined = np.zeros(0x110000, bool)
        self.joined[[ord(c) for c in pieces.joined - {MARK}]] = True
        self.shift, self.deepest = np.uint64(64 - bits), int(np.diff(self.table).max())

    @classmethod
    def extend(cls, value: np.ndarray, chars: np.ndarray) -> np.ndarray:
        x = (value ^ chars) * cls._ODD
        return x ^ (x >> np.uint64(29))

    def start(self, n: int) -> np.ndarray:
        return np.full(n, self._START)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Row of the piece with this running hash, or -1."""
        value = value * self._ODD
        bucket = (value >> self.shift).astype(np.int64)
        first = self.table[bucket]
        out = np.full(len(value), -1, np.int64)
        some = np.flatnonzero(self.table[bucket + 1] > first)  # most buckets are empty
        value, first = value[some], first[some]
        for k in range(self.deepest):
            at = np.minimum(first + k, len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == value)
            out[some[hit]] = at[hit]
        return out


def pretokens(texts: list[str], lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all escaped texts, where each pre-token begins (and the last ends), and each text's number of pre-tokens.

    The same pre-tokens as those of `splitter`."""
    flat, start = code_points([escape(t) for t in texts])
    own, mark = lookup.joined[flat], flat == ord(MARK)
    first = np.ones(len(flat), bool)
    first[1:] = ~(own[1:] & (own | mark)[:-1] | mark[1:] & mark[:-1])
    first[start[start < len(flat)]] = True
    begin = np.append(np.flatnonzero(first), len(flat))
    return flat, begin, np.diff(np.searchsorted(begin, start))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words one after the other, and where each word starts."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


