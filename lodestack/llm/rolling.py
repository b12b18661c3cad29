"""Vectorised hashing of words and spans over the bytes of many texts at once."""

from __future__ import annotations

import re

import numpy as np

#: fixed values: an odd multiplier and its inverse modulo 2**64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

WORD = re.compile(r"[^\W_]+")

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _P, np.uint64)
        down = np.full(size, _PINV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of any spans [start, end) of an array of bytes or words, each in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one line feed after each, and the offset at which each text starts (and the end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), starts


def words_of(data: np.ndarray, starts: np.ndarray, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run without a byte of ``gaps``, and how many such words lie before each text."""
    table = np.zeros(256, bool)
    table[list(gaps)] = True
    space = table[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    return first, last, np.searchsorted(first, starts)


def normalised(text: str | None) -> str:
    """Lower-cased words (runs of letters and digits) joined by single blanks."""
    return " ".join(WORD.findall(text.lower())) if text else ""


def triples(texts: list[str], run: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word triples of each text as hashes: all of them in text order, and the offsets of the texts.

    A text of fewer than three words has none.
    """
    data, starts = utf8([normalised(t) for t in texts])
    first, last, before = words_of(data, starts, b" \n")
    n = len(first)
    if n < run:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    spans = Spans(data)
    text_of = np.repeat(np.arange(len(texts)), np.diff(before))
    whole = text_of[: n - run + 1] == text_of[run - 1 :]
    codes = spans.hash(first[: n - run + 1][whole], last[run - 1 :][whole])
    owner = text_of[: n - run + 1][whole]
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    return codes, np.searchsorted(owner, np.arange(len(texts) + 1))
