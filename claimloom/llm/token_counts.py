"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A pre-token's count depends on its own characters alone, so a document's count
is the sum over its pre-tokens. The leaves of its tree are runs of pre-tokens,
every node sums the characters and the tokens below it. An edit re-splits only
from the leaf whose context it touches to the first old leaf boundary that the
new split meets again, re-counts those pre-tokens and updates the sums on their
paths to the root; a leaf that grows too long is split and the tree with it.

Trees are columns beside the text (two heaps of numbers), so that they can be
kept in a table and edited again and again without a full count.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import REMEMBERED, Batches, column, slices, tidy, tokenizer_file, utf8

#: Fixed value: the split that the 50k byte-pair vocabulary was made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A split looks at most so many characters ahead: a contraction's two letters and the next character.
CONTEXT = 4
#: Pre-tokens in a leaf of a new tree; one that grows beyond four times as many is split.
LEAF = 32
_CACHE = 150_000

Edit = tuple[int, int, str]  # start, end (exclusive) in the old text, replacement


class Counter:
    """Token counts of pre-tokens by one byte-pair vocabulary."""

    def __init__(self, path: str, pattern: str = SPLIT):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, pretokens: Sequence[str]) -> list[int]:
        known = self.known
        out = [known.get(p) for p in pretokens]
        if None in out:
            if len(known) > _CACHE:
                known.clear()
            for k, n in enumerate(out):
                if n is None:
                    p = pretokens[k]
                    n = known.get(p)
                    if n is None:
                        n = len(self.encoding.encode_ordinary(p))
                        if len(p) <= 64:
                            known[p] = n
                    out[k] = n
        return out

    def leaves(self, pretokens: Sequence[str], size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of runs of `size` pre-tokens."""
        if not pretokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, at = len(pretokens), np.arange(0, len(pretokens), size)
        return np.add.reduceat(np.fromiter(map(len, pretokens), np.int64, n), at), np.add.reduceat(np.array(self.count(pretokens), np.int64), at)


@lru_cache(maxsize=4)
def counter(path: str, pattern: str = SPLIT) -> Counter:
    return Counter(path, pattern)


REMEMBERED[__name__] = counter.cache_clear


def heap(leaves: np.ndarray) -> np.ndarray:
    """Sums above the leaves: node k has the children 2k and 2k + 1, node 1 is the root, the leaves fill the second half."""
    size = 1 << (max(1, len(leaves)) - 1).bit_length()
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(leaves)] = leaves
    while size > 1:
        out[size // 2 : size] = out[size : 2 * size : 2] + out[size + 1 : 2 * size : 2]
        size //= 2
    return out


class TokenTree:
    """One document's text with the characters and tokens of its leaves and the sums above them."""

    def __init__(self, text: str, counter: Counter, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        """A new tree, or one that was kept: chars and tokens are the heaps of the same text."""
        self.text, self.counter, self.recounted = text, counter, 0
        if chars is None or tokens is None:
            own = counter.leaves(counter.split.findall(text))
            chars, tokens = heap(own[0]), heap(own[1])
        self.chars, self.tokens = chars, tokens

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        at = self.size + leaf
        more, other = chars - self.chars[at], tokens - self.tokens[at]
        while at and (more or other):
            self.chars[at] += more
            self.tokens[at] += other
            at //= 2

    def usable(self, edits: Sequence[Edit]) -> list[Edit]:
        """The edits in order, without those that leave the text, run backwards or begin inside an earlier one."""
        out, at = [], 0
        for a, b, r in sorted(edits, key=lambda e: (e[0], e[1])):
            if at <= a <= b <= len(self.text):
                out.append((a, b, r))
                at = b
        return out

    def edit(self, edits: Sequence[Edit]) -> str:
        """Applies the usable edits (old offsets in code points), updates the sums and returns the new text."""
        edits = [(a, b, r) for a, b, r in self.usable(edits) if a != b or r]
        if not edits:
            return self.text
        parts, at = [], 0
        for a, b, r in edits:
            parts += [self.text[at:a], r]
            at = b
        new = "".join(parts) + self.text[at:]
        ends = np.cumsum(self.chars[self.size :])
        match = self.counter.split.match
        grown: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # first leaf: last leaf (exclusive), what stands there now
        k, shift = 0, 0  # shift: new minus old offsets left of edit k
        while k < len(edits):
            # The first leaf that may see the edit: it ends within CONTEXT before it or after.
            leaf = min(int(np.searchsorted(ends, edits[k][0] - CONTEXT, side="right")), self.size - 1)
            place = (int(ends[leaf - 1]) if leaf else 0) + shift
            clear = edits[k][1]  # old offset behind which the text is unchanged up to the next edit
            shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
            k += 1
            found: list[str] = []
            stop = None
            while stop is None:
                own = match(new, place) if place < len(new) else None
                if own is not None:
                    found.append(own[0])
                    place = own.end()
                while k < len(edits) and place - shift + CONTEXT >= edits[k][0]:
                    clear = edits[k][1]
                    shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                    k += 1
                back = place - shift
                if own is None:
                    stop = self.size
                elif back >= clear:
                    meet = int(np.searchsorted(ends, back))
                    if meet < self.size and ends[meet] == back:
                        stop = meet + 1
            self.recounted += len(found)
            each = max(LEAF, -(-len(found) // (stop - leaf)))  # pre-tokens for each old leaf
            grown[leaf] = (stop, *self.counter.leaves(found, each if each <= 4 * LEAF else LEAF))
        if all(len(own) <= stop - leaf for leaf, (stop, own, _) in grown.items()):
            for leaf, (stop, chars, tokens) in grown.items():
                for j in range(leaf, stop):
                    known = j - leaf < len(chars)
                    self._set(j, int(chars[j - leaf]) if known else 0, int(tokens[j - leaf]) if known else 0)
        else:
            self._grow(grown)
        self.text = new
        return new

    def _grow(self, grown: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Puts in more leaves than the tree has room for: old leaves and new ones side by side, sums anew (no count)."""
        own = [self.chars[self.size :], self.tokens[self.size :]]
        parts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        at = 0
        for leaf, (stop, *new) in sorted(grown.items()):
            for side in (0, 1):
                parts[side].extend((own[side][at:leaf], new[side]))
            at = stop
        whole = [np.concatenate([*parts[side], own[side][at:]]) for side in (0, 1)]
        used = whole[0] > 0
        self.chars, self.tokens = heap(whole[0][used]), heap(whole[1][used])


_TREE = "doc_id long, text string, chars array<bigint>, tokens array<bigint>"
_LONGS = pa.list_(pa.int64())


def _build(path: str, pattern: str, batches: Batches) -> Batches:
    own = counter(path, pattern)
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, 2 << 20):
            part = batch.slice(a, b - a)
            trees = [TokenTree(t or "", own) for t in part.column(1).to_pylist()]
            sums = [pa.array([getattr(t, side) for t in trees], _LONGS) for side in ("chars", "tokens")]
            yield pa.record_batch([*part.columns[:2], *sums, *part.columns[2:]], ["doc_id", "text", "chars", "tokens", *part.schema.names[2:]])


def _edit(path: str, pattern: str, find: str | None, put: str, batches: Batches) -> Batches:
    own, finder = counter(path, pattern), re.compile(find) if find else None
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, 2 << 20):
            part = batch.slice(a, b - a)
            texts, chars, tokens, facts = [], [], [], []
            for text, c, t, edits in zip(part.column(1).to_pylist(), part.column(2), part.column(3), part.column(4).to_pylist(), strict=True):
                tree = TokenTree(text or "", own, *(np.array(x.values) if x.is_valid else None for x in (c, t)))
                wanted = [(e["start"], e["stop"], e["put"] or "") for e in edits or () if e and e["start"] is not None and e["stop"] is not None]
                if finder is not None:
                    wanted += [(m.start(), m.end(), put) for m in finder.finditer(tree.text)]
                done = len(tree.usable(wanted))
                new = tree.edit(wanted)
                texts.append(text if not done else new)
                chars.append(tree.chars)
                tokens.append(tree.tokens)
                facts.append((tree.recounted, done, len(wanted) - done))
            columns = list(zip(*facts, strict=True)) or [[]] * 3
            yield pa.record_batch(
                [part.column(0), pa.array(texts, pa.string()), pa.array(chars, _LONGS), pa.array(tokens, _LONGS), *part.columns[5:], *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "text", "chars", "tokens", *part.schema.names[5:], "n_recounted", "n_edits", "n_skipped"],
            )


def token_trees(docs: DataFrame, carry: Sequence[str] = (), folder: str | None = None, file: str = "byte_bpe_50k.tiktoken", pattern: str = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, the heaps chars and tokens of its tree, and row (a struct of the carried columns) for each row.

    The token count is tokens[1]. Null and empty texts have a tree without
    tokens. Repeated rows give repeated rows; other columns are ignored. An empty
    table gives an empty table.
    """
    kept = F.struct(*[column(c).alias(c) for c in carry]) if carry else F.lit(None).cast("struct<unused:int>")
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), kept.alias("row"))
    return rows.mapInArrow(tidy(_build, tokenizer_file(file, folder), pattern), StructType.fromDDL(_TREE).add(rows.schema["row"]))


def edit_trees(trees: DataFrame, edits: Column | None = None, find: str | None = None, put: str = "", folder: str | None = None, file: str = "byte_bpe_50k.tiktoken", pattern: str = SPLIT) -> DataFrame:
    """The trees (as token_trees returns them) of the edited texts, with n_recounted, n_edits and n_skipped of this edit.

    edits: array of (start, stop, put) in code points of the text; null means
    none. find: a regular expression of Python each of whose matches is replaced
    by `put`. Edits may come in any order; one that leaves the text, runs
    backwards or begins inside an earlier one is skipped and counted in
    n_skipped. A null text takes insertions at 0 and else stays null. The result
    can be edited again.
    """
    kind = "array<struct<start:bigint,stop:bigint,put:string>>"
    rows = trees.select("doc_id", "text", "chars", "tokens", (F.lit(None) if edits is None else edits).cast(kind).alias("edits"), "row")
    schema = f"{_TREE}, row {rows.schema['row'].dataType.simpleString()}, n_recounted long, n_edits long, n_skipped long"
    return rows.mapInArrow(tidy(_edit, tokenizer_file(file, folder), pattern, find, put), schema)


def count_tokens() -> Column:
    """The token count of a tree's row: the root of its heap."""
    return F.element_at("tokens", 2).cast("long")
