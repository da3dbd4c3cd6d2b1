"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary is a byte-pair model with byte fallback. A segmentation is the
model's own exactly when each two neighbouring pieces are what the model makes
of the two together, so encoding is a best path in the max-plus semiring: nodes
are pieces in place, a step to the next piece weighs 0 if the pair stands and
minus infinity if not. Just one path has weight 0: merging is deterministic and
works inside any stretch that no applied merge crosses as it does on the stretch
alone, so the model's own segmentation has pairs that all stand, and a path
whose pairs all stand is reached by the same merges. All entries of a transfer
matrix thus are 0 or minus infinity and are kept as one bit each; the max-plus
product is the product of bit matrices. Tests count the paths of random texts
and send whole tables through chunks of a few characters.

A giant text is cut into chunks. The states at a boundary are the pieces that
may straddle it or end at it. Each chunk yields the transfer matrix from its
left states to its right ones without knowing its neighbours; matrices are
combined associatively into the state that each boundary takes, and each chunk
is then backtraced on its own. In Spark the chunks of giant documents are rows:
their matrices are computed in parallel and only they (never the chunks' text)
are gathered by document for the scan.

No piece holds a space mark after another character, so spaces cut every text
into units that no piece crosses; a text's units are segmented by the same path
search, with a bounded memory of earlier units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Batches, REMEMBERED, checkpointed, column, shuffle_width, slices, tidy, tokenizer_file, utf8

MARK = "▁"  # stands for a space inside pieces
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MEMORY, _PAIRS = 150_000, 300_000
Piece = tuple[int, int, int]  # start, end, id


class _Words(dict):
    """Packed ids of words: those after a space, or those after a line's end. Two generations of short words are remembered."""

    def __init__(self, model: Model, mark: str):
        self.model, self.mark, self.older = model, mark, {}

    def __missing__(self, word: str) -> bytes:
        if "\n" in word and self.model.lines:  # no piece holds a line's end, so the parts are segmented apart
            first, *rest = word.split("\n")
            return self.model.line_end.join([self[first], *map(self.model.after_line.__getitem__, rest)])
        found = self.older.get(word)
        if found is None:
            text = self.mark + word
            found = np.array(self.model.ids(text, self.model.path(text)), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= _MEMORY:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Model:
    """Pieces, and what the model makes of a pair of them."""

    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.vocab_size()
        names = [own.id_to_piece(i) for i in range(size)]
        self.pieces = {n: i for i, n in enumerate(names) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))}
        self.names = names
        self.scores = {i: own.get_score(i) for i in self.pieces.values()}
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.pieces))
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, bool] = {}
        sizes: dict[str, set[int]] = {}
        for p in self.pieces:
            if len(p) > 3:
                sizes.setdefault(p[:4], {1, 2, 3}).add(len(p))
        #: Lengths of pieces by their first four characters, longest first; other pieces have three at most.
        self.sizes = {p: tuple(sorted(own, reverse=True)) for p, own in sizes.items()}
        self.lines = not any("\n" in p for p in self.pieces)
        self.line_end = np.array([self.bytes[10]], np.int32).tobytes()
        self.after_space, self.after_line = _Words(self, MARK), _Words(self, "")
        self.shown = [n if i in self.scores else "" for i, n in enumerate(names)]
        for b in range(128):  # a byte below 128 is a character of its own
            self.shown[self.bytes[b]] = chr(b)
        self.wide_bytes = np.zeros(size, bool)
        self.wide_bytes[self.bytes[128:]] = True

    def normal(self, text: str) -> str:
        """The model's normal form: a leading space, and marks for spaces."""
        return MARK + text.replace(" ", MARK) if text else ""

    # -- what the model makes of a short string -------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Merges the best-scored neighbours, leftmost first, until none makes a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            x, y = self.names[a], self.names[b]
            found = self.merge(x + y) == [x, y]
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def whole(self, name: str, i: int) -> bool:
        """Whether the model makes this piece of its own characters."""
        found = self.made.get(i)
        if found is None:
            found = self.made[i] = self.merge(name) == [name]
        return found

    # -- path search ---------------------------------------------------------------------

    def starting(self, text: str, at: int, stop: int) -> list[Piece]:
        """Every piece that stands at a place; a character without one is itself, with id -1."""
        out = []
        for end in range(at + 1, min(at + self.longest, stop) + 1):
            i = self.pieces.get(text[at:end])
            if i is not None and self.whole(text[at:end], i):
                out.append((at, end, i))
        if not out or out[0][1] != at + 1:
            if text[at] not in self.pieces:
                out.insert(0, (at, at + 1, -1))
        return out

    def follows(self, a: Piece | None, b: Piece) -> bool:
        return a is None or a[2] < 0 or b[2] < 0 or self.stands(a[2], b[2])

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of one unit: the path search over a single chunk."""
        found = self.known.get(text)
        if found is None:
            found = self.older.get(text) or tuple(self.ids(text, self.path(text)))
            if len(text) <= 64:
                if len(self.known) > _MEMORY:
                    self.known, self.older = {}, self.known
                self.known[text] = found
        return found

    def path(self, text: str) -> list[Piece]:
        """The only standing path through a text, longest steps first.

        A place that a standing path reaches has just that path, so a place
        from which no step leads on is dead for good and the search is linear.
        """
        n, pieces, sizes, dead = len(text), self.pieces, self.sizes, set()
        out: list[Piece] = []
        at, last, most = 0, -1, n  # most: where the next step may end
        while at < n:
            step = None
            for size in sizes.get(text[at : at + 4], (3, 2, 1)):
                end = at + size
                if end > most or end in dead:
                    continue
                i = pieces.get(text[at:end])
                if i is None:
                    if size == 1:
                        step = (at, end, -1)
                elif self.whole(text[at:end], i) and (last < 0 or self.stands(last, i)):
                    step = (at, end, i)
                    break
            if step is None:
                dead.add(at)
                at, end, _ = out.pop()
                most = end - 1
                last = out[-1][2] if out else -1
                continue
            out.append(step)
            at, last, most = step[1], step[2], n
        return out

    def ids(self, text: str, path: Sequence[Piece]) -> list[int]:
        out: list[int] = []
        for start, end, i in path:
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes[b] for b in text[start:end].encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            units = _UNIT.findall(self.normal(text))
        else:
            units = [MARK + w for w in text.split(" ")] if text else []
        for u in units:
            out += self.known.get(u) or self.unit(u)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if self.crossing or "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return np.array(self.encode(text), np.int32).tobytes()
        return b"".join(map(self.after_space.__getitem__, text.split(" "))) if text else b""

    # -- chunks of giant texts -----------------------------------------------------------

    def _clean(self, text: str, at: int) -> bool:
        """Whether a unit begins here, so that no piece crosses the place."""
        return not self.crossing and 0 < at < len(text) and text[at] == MARK and text[at - 1] != MARK

    def states(self, text: str, at: int) -> list[Piece]:
        """The states of a boundary: pieces that begin before it and end at it or behind it; one state where a unit begins."""
        if self._clean(text, at):
            return [(at, at, -2)]
        return [p for start in range(max(0, at - self.longest), at) for p in self.starting(text, start, len(text)) if p[1] >= at]

    def _walk(self, text: str, stop: int, seeds: dict[Piece, int]) -> dict[int, dict[Piece, tuple[int, Piece | None]]]:
        """All steps of weight 0 from the seeds: nodes by their end, each with the seeds that reach it (as bits) and a predecessor.

        Where a unit begins all paths meet in the node (at, at, -2); whole units
        up to the last such place before `stop` are one step.
        """
        nodes: dict[int, dict[Piece, tuple[int, Piece | None]]] = {}
        for piece, mask in seeds.items():
            nodes.setdefault(piece[1], {})[piece] = (mask, None)
        at = min(nodes)
        while at <= stop:
            own = nodes.get(at)
            meet = (at, at, -2)
            if own and (meet in own or self._clean(text, at)):
                if meet not in own:
                    mask = 0
                    for m, _ in own.values():
                        mask |= m
                    own[meet] = (mask, next(iter(own)))
                far = next((q for q in range(min(stop, len(text)), at, -1) if self._clean(text, q)), at)
                if far > at:
                    nodes.setdefault(far, {})[(far, far, -2)] = (own[meet][0], meet)
                    at = far
                    continue
                own = {meet: own[meet]}
            if own and at < stop:
                for piece, (mask, _) in own.items():
                    for after in self.starting(text, at, len(text)):
                        if self.follows(piece, after):
                            there = nodes.setdefault(after[1], {})
                            before = there.get(after)
                            there[after] = (mask | before[0], before[1]) if before else (mask, piece)
            at += 1
        return nodes

    def transfer(self, text: str, a: int, b: int, first: bool, last: bool) -> list[int]:
        """For each right state of the chunk text[a:b], the left states (as bits) with score 0 to it; all others are minus infinity."""
        left = [(a, a, -2)] if first else self.states(text, a)
        nodes = self._walk(text, b, {p: 1 << k for k, p in enumerate(left)})
        if last:
            mask = 0
            for m, _ in nodes.get(b, {}).values():
                mask |= m
            return [mask]
        return [nodes.get(p[1], {}).get(p, (0, None))[0] for p in self.states(text, b)]

    def backtrace(self, text: str, a: int, b: int, left: int, right: int, first: bool, last: bool) -> list[int]:
        """Ids from behind the left state up to the right one, both given by their number."""
        seed = (a, a, -2) if first else self.states(text, a)[left]
        nodes = self._walk(text, b, {seed: 1})
        node = next(iter(nodes[b])) if last else self.states(text, b)[right]
        parts: list[list[int]] = []
        while node != seed:
            before = nodes[node[1]][node][1]
            if node[2] != -2:
                parts.append(self.ids(text, [node]))
            elif before[1] < node[1]:
                parts.append([i for u in _UNIT.findall(text[before[1] : node[1]]) for i in (self.known.get(u) or self.unit(u))])
            node = before
        return [i for part in reversed(parts) for i in part]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes join into characters, and the leading space goes."""
        own = np.asarray(ids)
        if not len(own):
            return ""
        if own.min() >= 0 and own.max() < len(self.shown) and not self.wide_bytes[own].any():
            text = "".join(map(self.shown.__getitem__, own.tolist())).replace(MARK, " ")
            return text[1:] if text[:1] == " " else text
        parts, raw = [], bytearray()
        for i in own.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.scores:
                parts.append(self.names[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


REMEMBERED[__name__] = model.cache_clear


def compose(one: Sequence[int], two: Sequence[int]) -> list[int]:
    """The max-plus product of two transfer matrices (each a list of left-state bits by right state)."""
    out = []
    for mask in two:
        total, k = 0, 0
        while mask >> k:
            if mask >> k & 1:
                total |= one[k]
            k += 1
        out.append(total)
    return out


def settle(matrices: list[list[int]]) -> list[int]:
    """The state at each right boundary on the one path of score 0.

    Products of neighbours are combined in a balanced tree (they are
    associative); going down, each half learns the state at its ends.
    """

    def product(a: int, b: int) -> list[int]:
        if (a, b) not in kept:
            kept[a, b] = matrices[a] if b - a == 1 else compose(product(a, (a + b) // 2), product((a + b) // 2, b))
        return kept[a, b]

    kept: dict[tuple[int, int], list[int]] = {}
    out = [0] * len(matrices)
    open_ranges = [(0, len(matrices), 0, 0)]  # first, last, left state, right state
    while open_ranges:
        a, b, left, right = open_ranges.pop()
        out[b - 1] = right
        if b - a > 1:
            m = (a + b) // 2
            one, two = product(a, m), product(m, b)
            middle = next((k for k in range(len(one)) if one[k] >> left & 1 and two[right] >> k & 1), 0)
            open_ranges += [(a, m, left, middle), (m, b, middle, right)]
    return out


def cut(text: str, chunk: int, margin: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(number, chunks in all, window, start and end of the chunk in the window) of a normalised text."""
    of = max(1, -(-len(text) // chunk))
    for k in range(of):
        a, b = k * chunk, min(len(text), (k + 1) * chunk)
        low = max(0, a - margin)
        yield k, of, text[low : b + margin], a - low, b - low


_HEAD = "doc_id long, row long, digest string, no long, total long"


def _encode_small(path: str, batches: Batches) -> Batches:
    own = model(path)
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, 1 << 20):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            ids = [own.packed(t or "") for t in texts]
            back = [own.decode(np.frombuffer(i, np.int32)) == (t or "") for i, t in zip(ids, texts, strict=True)]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pieces, pa.array(back)], ["doc_id", "digest", "pieces", "round_trip"])


def _cut(path: str, chunk: int, batches: Batches) -> Batches:
    own = model(path)
    for batch in batches:
        for k, text in enumerate(batch.column(1).to_pylist()):
            rows = list(cut(own.normal(text or ""), chunk, 2 * own.longest))
            at = pa.array([k] * len(rows), pa.int64())
            no, of, window, a, b = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0).take(at), batch.column(3).take(at), batch.column(2).take(at), pa.array(no, pa.int64()), pa.array(of, pa.int64()), pa.array(window), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "row", "digest", "no", "total", "window", "a", "b"])


def _matrices(path: str, batches: Batches) -> Batches:
    own = model(path)
    for batch in batches:
        out = []
        for no, of, window, a, b in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
            out.append([m.to_bytes((m.bit_length() + 7) // 8, "little") for m in own.transfer(window, a, b, no == 0, no == of - 1)])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], ["row", "no", "matrix"])


def _scan(table: pa.Table) -> pa.Table:
    table = table.sort_by("no")
    matrices = [[int.from_bytes(m, "little") for m in matrix] for matrix in table.column("matrix").to_pylist()]
    right = settle(matrices)
    return pa.table([table.column("row"), table.column("no"), pa.array([0, *right[:-1]], pa.int64()), pa.array(right, pa.int64())], ["row", "no", "left_state", "right_state"])


def _backtrace(path: str, batches: Batches) -> Batches:
    own = model(path)
    for batch in batches:
        ids = [own.backtrace(w, a, b, x, y, no == 0, no == of - 1) for no, of, w, a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 10)), strict=True)]
        yield pa.record_batch([*[batch.column(k) for k in range(4)], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "digest", "no", "ids"])


def encode_pieces(docs: DataFrame, folder: str | None = None, file: str = "piece_bpe_32k.model", giant: int = 32_768, chunk: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (sha256 of the text), pieces (array of ids) and round_trip (whether they decode to the text) for each row.

    Texts of more than `giant` characters go through the chunk scan. Null and
    empty texts have no pieces and the digest of the empty text. Repeated rows
    give repeated rows; other columns are ignored. An empty table gives an
    empty table.
    """
    path = tokenizer_file(file, folder)
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    small = rows.where(F.length("text") <= giant).mapInArrow(tidy(_encode_small, path), "doc_id long, digest string, pieces array<int>, round_trip boolean")
    long = rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id())
    chunks = checkpointed(long.mapInArrow(tidy(_cut, path, chunk), f"{_HEAD}, window string, a long, b long"))
    chunks = chunks.repartition(shuffle_width(docs.sparkSession), "row", "no")
    matrices = chunks.select("row", "no", "total", "window", "a", "b").mapInArrow(tidy(_matrices, path), "row long, no long, matrix array<binary>")
    states = matrices.groupBy("row").applyInArrow(_scan, "row long, no long, left_state long, right_state long")
    placed = chunks.join(states, ["row", "no"]).select("doc_id", "row", "digest", "no", "total", "window", "a", "b", "left_state", "right_state")
    done = placed.mapInArrow(tidy(_backtrace, path), "doc_id long, row long, digest string, no long, ids array<int>")
    whole = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    joined = whole.select("doc_id", "digest", F.flatten("parts.ids").alias("pieces"))
    checked = decode_pieces(joined, folder, file, digest_only=True)
    return small.unionByName(checked.select("doc_id", "digest", "pieces", (F.col("digest") == F.col("text_sha256")).alias("round_trip")))


def decode_pieces(encoded: DataFrame, folder: str | None = None, file: str = "piece_bpe_32k.model", ids_col: str = "pieces", digest_only: bool = False) -> DataFrame:
    """All columns and text, decoded from the ids; with digest_only its sha256 as text_sha256 instead.

    A column that has the new one's name already is replaced; others may be called anything.
    Null arrays decode to null, empty ones to the empty text; ids outside the
    vocabulary and control ids add nothing.
    """
    path = tokenizer_file(file, folder)
    name = "text_sha256" if digest_only else "text"

    encoded = encoded.drop(name) if name != ids_col else encoded
    place = encoded.columns.index(ids_col)

    def run(batches: Batches) -> Batches:
        own = model(path)
        for batch in batches:
            out = []
            for ids in batch.column(place):
                text = None if not ids.is_valid else own.decode(np.asarray(ids.values).tolist())
                out.append(text if text is None or not digest_only else hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return encoded.mapInArrow(tidy(run), StructType([*encoded.schema.fields, StructField(name, StringType())]))
