"""Words of many texts at once, from their UTF-8 bytes.

Separators are ASCII in every contract, so splitting bytes splits code points
alike. A word is known by a keyed 128-bit digest of its bytes, held as two
64-bit lanes; n-grams mix the lanes of their words apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

from .common import REMEMBERED

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
_KEY = b"claimloom words"
_MEMORY, _LONG = 150_000, 64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Digests(dict):
    """Digests by word; short words are remembered, so that each is digested once."""

    def __missing__(self, word: bytes) -> bytes:
        found = blake2b(word, digest_size=16, key=_KEY).digest()
        if len(word) <= _LONG:
            if len(self) >= _MEMORY:
                self.clear()
            self[word] = found
        return found


_known = _Digests()
REMEMBERED[__name__] = _known.clear


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    row: np.ndarray  # row of each word
    lanes: np.ndarray  # two 64-bit halves of each word's digest

    @property
    def hashes(self) -> np.ndarray:
        return self.lanes[:, 0]

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def digest(word: bytes) -> bytes:
    return _known[word]


def words(raw: np.ndarray, offsets: np.ndarray, table: bytes | None = LOWER) -> Words:
    """Words of all rows, split at the six ASCII spaces after each byte went through the table."""
    counts, lanes = np.zeros(len(offsets) - 1, np.int64), []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = raw[a:b].tobytes()
        terms = (text.translate(table) if table else text).split()
        counts[k] = len(terms)
        lanes.append(b"".join(map(_known.__getitem__, terms)))
    return Words(np.repeat(np.arange(len(counts)), counts), np.frombuffer(b"".join(lanes), U).reshape(-1, 2))


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of `width` words within one row."""
    if len(hashes) < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
    total = np.zeros(len(first), U)
    for k in range(width):
        total = mix(total + hashes[first + k] * STEP + U(k + 1))
    return total, first
