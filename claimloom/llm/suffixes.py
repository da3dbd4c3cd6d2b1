"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting is linear, but one suffix at a time. Here a bucket's suffixes
go in waves: all that are known to stand in a bucket pass on their predecessors
at once, and only predecessors that fall into the same bucket (runs of one
symbol) need a further wave.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last symbol is the smallest and stands once."""
    n = len(text)
    steps = np.flatnonzero(text[1:] != text[:-1])  # the last position of each run
    up = text[steps + 1] > text[steps]
    out = np.ones(n, bool)
    out[: n - 1] = np.repeat(up, np.diff(steps, prepend=-1))
    return out


def _deal(symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, each element's rank within its symbol, and the counts of symbols."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=most)
    rank = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order, rank, counts


def induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffixes in the order that `starts` (leftmost smaller suffixes, in order) induces: larger ones left to right, then smaller ones right to left."""
    n, k = len(text), int(text.max()) + 1
    counts = np.bincount(text, minlength=k)
    ends = np.cumsum(counts)
    heads = ends - counts
    out = np.full(n, -1, np.int32)
    order, _, of = _deal(text[starts], k)
    seeds = np.split(starts[order], np.cumsum(of)[:-1])

    head = heads.copy()

    def larger(source: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[~small[before]]
        if len(before):
            symbols = text[before]
            order, rank, add = _deal(symbols, k)
            out[head[symbols[order]] + rank] = before[order]
            head[:] += add

    for c in range(k):
        done = heads[c]
        while done < head[c]:
            wave, done = out[done : head[c]], head[c]
            larger(wave)
        larger(seeds[c])

    tail = ends.copy()

    def smaller(source: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[small[before]]
        if len(before):
            symbols = text[before]
            order, rank, add = _deal(symbols, k)
            out[tail[symbols[order]] - 1 - rank] = before[order]
            tail[:] -= add

    for c in range(k - 1, 0, -1):
        done = ends[c]
        while done > tail[c]:
            wave, done = out[tail[c] : done][::-1], tail[c]
            smaller(wave)
        smaller(out[heads[c] : head[c]][::-1])
    out[0] = n - 1  # the last symbol's suffix; the one before it is larger
    return out


def _names(text: np.ndarray, starts: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """A number for each leftmost smaller substring in text order, by the order given; equal substrings get equal numbers."""
    n = len(text)
    length = np.zeros(n, np.int32)
    length[starts[:-1]] = np.diff(starts) + 1
    length[starts[-1]] = 1
    a, b = in_order[:-1].astype(np.int64), in_order[1:].astype(np.int64)
    same = length[a] == length[b]
    open_, step = np.flatnonzero(same), 0
    while len(open_):
        equal = text[a[open_] + step] == text[b[open_] + step]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal]
        open_ = open_[length[a[open_]] > step]
    name = np.zeros(n, np.int64)
    name[in_order] = np.concatenate([[0], np.cumsum(~same)])
    return name[starts]


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names: each round names pairs of neighbours of the round before, until all differ.

    Only names that still stand more than once are sorted again.
    """
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    first = np.searchsorted(rank[order], rank[order])  # a name counts the smaller ones
    rank[order] = first
    reach = 1
    while True:
        sorted_rank = rank[order]
        shared = np.zeros(n, bool)
        shared[1:] = sorted_rank[1:] == sorted_rank[:-1]
        shared[:-1] |= shared[1:].copy()
        at = np.flatnonzero(shared)
        if not len(at):
            return order
        own = order[at]
        far = own + reach
        after = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        again = np.argsort(key, kind="stable")
        own, key = own[again], key[again]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        reach *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; `text` has small integers, the last of which is the smallest and stands once."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = suffix_types(text)
    starts = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    rough = induce(text, small, starts)
    leftmost = np.zeros(n, bool)
    leftmost[starts] = True
    names = _names(text, starts, rough[leftmost[rough]])
    return induce(text, small, starts[_order_of_names(names)])


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; `raw` ends in eight bytes of padding."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))


def permuted_prefixes(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By position: bytes that its suffix shares with the one before it in order (0 for the first).

    Only irreducible values (whose suffixes have different bytes before them) are
    counted byte by byte; each position after one has one less.
    """
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    left = np.where((before > 0) & (at > 0), raw[np.maximum(before, 1) - 1] == raw[np.maximum(at, 1) - 1], False)
    own = np.flatnonzero(~left)
    words = _words(np.concatenate([raw[:n], np.zeros(8, np.uint8)]))
    values = np.zeros(len(own), np.int64)
    open_ = np.flatnonzero(before[own] >= 0)
    a, b = own[open_].astype(np.int64), before[own[open_]].astype(np.int64)
    while len(open_):
        differ = words[a] ^ words[b]
        whole = differ == 0
        part = np.flatnonzero(~whole)
        low = differ[part] & (~differ[part] + np.uint64(1))
        values[open_[part]] += np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3
        values[open_[whole]] += 8
        a, b, open_ = a[whole] + 8, b[whole] + 8, open_[whole]
        inside = (a < n) & (b < n)
        a, b, open_ = a[inside], b[inside], open_[inside]
    values = np.minimum(values, n - np.maximum(own, before[own]))
    index = np.cumsum(~left) - 1
    return values[index] - (at - own[index])
