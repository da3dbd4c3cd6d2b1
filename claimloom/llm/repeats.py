"""Removes byte strings that repeat anywhere in a corpus, by suffix arrays of shards.

1. Every string of `length` bytes is owned by one anchor: the short gram in it
   whose hash is smallest (the leftmost of equals). The starts that one anchor
   owns are neighbours; their text is the anchor's context. Equal strings are
   owned by equal grams at equal places, so contexts whose grams differ have no
   string in common, and the gram's hash deals contexts to shards.
2. Contexts are known by digests; equal ones become one with a count, also
   within a task before the shuffle, so that copies cost one row for each task.
   Only anchors that stand twice go on, and only one text for each context.
3. An anchor whose different contexts pass a shard's size is dealt anew, each
   string by its own digest, so that no group outgrows a task.
4. A task reads its anchors in order and builds a suffix array (induced sorting)
   and permuted common prefixes of one shard after another. Neighbours that
   share `length` bytes make a run; a run with two strings or more, counted with
   their contexts' copies, repeats.
5. The repeated starts go back to all places of their context, and from there to
   their documents, where covered bytes are cut.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, ship, shuffle_width, slices, tidy, utf8, written
from .suffixes import permuted_prefixes, suffix_array
from .words import U, mix

SLICE_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
#: Distinct contexts of one anchor may have this many bytes together; beyond, its strings are dealt one by one.
ANCHOR_BYTES = 4 << 20
#: Contexts with this share of all anchors or more (there can be no more than this many) are broadcast to their places.
HOT = 1000
_PLACE = U((1 << 24) - 1)
_ANCHORS = "row long, lo long, hi long, count long, stride long, hash long, ctx long"
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def gram_size(length: int) -> int:
    """A power of two: 32 bytes, fewer for short strings."""
    return 1 << max(0, min(5, (max(1, length // 6)).bit_length() - 1))


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last owned start (in raw) and gram hash of each anchor; raw has fewer than 2^24 bytes."""
    gram = gram_size(length)
    n = len(raw) - length + 1
    if n < 1:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U))
    hashes, size = _BYTE[raw], 1
    while size < gram:
        hashes = hashes[:-size] * U(2 * size + 0x9E3779B97F4A7C15) + hashes[size:]
        size *= 2
    hashes = mix(hashes)
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=U)
    window, reach = length - gram + 1, 1
    while 2 * reach <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < window:
        low = np.minimum(low[: n], low[window - reach : window - reach + n])
    place = (low & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), side="right") - 1
    inside = np.arange(n) + length <= offsets[row + 1]
    first = inside.copy()
    first[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    return row[starts], starts, np.flatnonzero(last), hashes[place[starts]]


def _pieces(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Slices of whole rows, or parts of long rows that overlap by length - 1: first row, its first byte, bytes, offsets."""
    for a, b in slices(offsets, SLICE_BYTES):
        if offsets[b] - offsets[a] <= SLICE_BYTES:
            yield a, 0, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            continue
        for at in range(0, int(offsets[b] - offsets[a]), SLICE_BYTES):
            part = raw[offsets[a] + at : min(offsets[b], offsets[a] + at + SLICE_BYTES + length - 1)]
            yield a, at, part, np.array([0, len(part)])


def _digest(text: memoryview) -> bytes:
    return blake2b(text, digest_size=8).digest()


def _anchor_rows(length: int, batches: Batches) -> Batches:
    """Anchors of texts; neighbours with one context at even steps (text that repeats itself) become one row."""
    for batch in batches:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        raw, offsets = utf8(batch.column(1))
        for base, shift, part, own in _pieces(raw, offsets, length):
            row, lo, hi, hashes = anchors(part, own, length)
            if not len(row):
                continue
            text = memoryview(np.ascontiguousarray(part))
            ctx = np.frombuffer(b"".join(_digest(text[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.int64)
            step = np.diff(lo, prepend=lo[0])
            alike = np.zeros(len(row), bool)
            alike[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]) & (ctx[1:] == ctx[:-1])
            go_on = alike.copy()
            go_on[1:] &= ~alike[:-1] | (step[1:] == step[:-1])
            head = np.flatnonzero(~go_on)
            count = np.diff(head, append=len(row))
            stride = np.where(count > 1, step[np.minimum(head + 1, len(row) - 1)], 0)
            start = own[row[head]] - shift
            columns = [names[base + row[head]], lo[head] - start, hi[head] - start, count, stride, hashes[head].view(np.int64), ctx[head]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["row", "lo", "hi", "count", "stride", "hash", "ctx"])


def _string_rows(length: int, batches: Batches) -> Batches:
    """Each string of the listed anchors as a row of its own, known by 128 bits of its digest."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        raw, offsets = utf8(batch.column(1))
        for k, listed in enumerate(batch.column(2).to_pylist()):
            text = memoryview(np.ascontiguousarray(raw[offsets[k] : offsets[k + 1]]))
            at = np.array([lo + t * stride + s for lo, hi, count, stride in (a.values() for a in listed) for t in range(count) for s in range(hi - lo + 1)], np.int64)
            for c in range(0, len(at), 1 << 16):
                own = at[c : c + (1 << 16)]
                keys = np.frombuffer(b"".join(blake2b(text[a : a + length], digest_size=16).digest() for a in own.tolist()), np.int64).reshape(-1, 2)
                one, zero = np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
                columns = [np.full(len(own), names[k]), own, own, one, zero, keys[:, 0], keys[:, 1]]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["row", "lo", "hi", "count", "stride", "hash", "ctx"])


def _context_texts(length: int, batches: Batches) -> Batches:
    """The text of each context that stands for its copies."""
    for batch in batches:
        raw, offsets = utf8(batch.column(0))
        out = [[], [], [], []]
        for k, listed in enumerate(batch.column(1).to_pylist()):
            for r in listed:
                a = offsets[k] + r["lo"]
                for column, value in zip(out, (r["hash"], r["ctx"], r["n"], raw[a : a + r["hi"] - r["lo"] + length].tobytes()), strict=True):
                    column.append(value)
        yield pa.record_batch([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], ["hash", "ctx", "n", "text"])


def repeated_starts(texts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the starts whose `length` bytes also start at another place of any text; a text stands `counts` times."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no byte of UTF-8; what crosses it is told by place below
    order = suffix_array(np.append(raw.astype(np.uint16) + 1, np.uint16(0)))[1:]
    prefixes = permuted_prefixes(raw, order)
    begins = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(len(texts)), sizes + 1)
    within = np.arange(len(raw)) - begins[own] + length <= sizes[own]
    run = np.cumsum(prefixes[order] < length) - 1
    strings = np.bincount(run, np.where(within, counts[own], 0)[order])
    again = np.zeros(len(raw), bool)
    again[order] = strings[run] > 1
    again &= within
    return [np.flatnonzero(again[a : a + s]) for a, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> list[int]:
    """First and last of each run of neighbours, in one list."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]], axis=1).ravel().tolist()


def _shards(length: int, batches: Batches) -> Batches:
    """Contexts sorted by anchor: suffix arrays of as many whole anchors as fill a shard."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        hashes, ctx, counts, texts = zip(*rows, strict=True)
        found = repeated_starts(list(texts), np.array(counts), length)
        kept = [k for k, starts in enumerate(found) if len(starts)]
        columns = [[hashes[k] for k in kept], [ctx[k] for k in kept], [counts[k] for k in kept]]
        runs = pa.array([_runs(found[k]) for k in kept], pa.list_(pa.int32()))
        return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], runs], ["hash", "ctx", "n", "runs"])

    waiting, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size >= SHARD_BYTES and row[0] != waiting[-1][0]:
                yield judged(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[3])
    if waiting:
        yield judged(waiting)


def _covered(places: list[dict], length: int) -> list[list[int]]:
    """The repeated starts of one text's contexts as disjoint covered runs (start, end), in order."""
    found = []
    for p in places:
        runs = p["runs"]
        for t in range(p["count"]):
            lo = p["lo"] + t * p["stride"]
            found += [(lo + a, lo + b + length) for a, b in zip(runs[::2], runs[1::2], strict=True)]
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(length: int, batches: Batches) -> Batches:
    """Texts without the bytes that repeated strings cover."""
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        data, kept, sizes, spans = memoryview(raw), [], [], []
        for first, end, places in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist(), strict=True):
            gone = _covered(places, length) if places else []
            edges = [0, *(e for run in gone for e in run), end - first]
            kept.append(b"".join(data[first + a : first + b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(end - first)
            spans.append([{"start": a, "end": b} for a, b in gone])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _contexts(found: DataFrame) -> DataFrame:
    """Different contexts of anchors that stand twice or more: hash, ctx, n, where one stands, and the bytes of all of the anchor's contexts."""
    each = found.groupBy("hash", "ctx").agg(F.sum("count").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("at"))
    total = each.groupBy(F.col("hash").alias("of")).agg(F.sum("n").alias("total"), F.sum(F.col("at.hi") - F.col("at.lo")).alias("starts"), F.count("*").alias("contexts"))
    return each.join(total.where("total > 1"), F.col("hash") == F.col("of")).select("hash", "ctx", "n", "at.row", "at.lo", "at.hi", "starts", "contexts")


def cut_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without bytes covered by a `length`-byte string that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, spans (removed runs: start, end in
    bytes) and kept (binary: a cut may fall within a character). Strings are
    judged on the input: all places of a repeated string go, those within one
    text and overlaps included; matches never cross texts. Null texts count as
    empty; texts shorter than `length` stay whole. Rows that repeat an id are
    texts of their own. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")), "texts")
    found = written(texts.select("row", "text").mapInArrow(tidy(_anchor_rows, length), _ANCHORS), "anchors")
    chosen = written(_contexts(found), "contexts")
    too_wide = F.col("starts") + F.col("contexts") * length > ANCHOR_BYTES
    wide = written(chosen.where(too_wide).select(F.col("hash").alias("of")).distinct(), "wide")
    if not wide.isEmpty():
        one_by_one = found.join(wide, F.col("hash") == F.col("of"), "left_semi").groupBy(F.col("row").alias("in")).agg(F.collect_list(F.struct("lo", "hi", "count", "stride")).alias("listed"))
        strings = texts.join(one_by_one, F.col("row") == F.col("in")).select("row", "text", "listed").mapInArrow(tidy(_string_rows, length), _ANCHORS)
        strings = written(strings, "strings")
        found = found.join(wide, F.col("hash") == F.col("of"), "left_anti").unionByName(strings)
        chosen = chosen.where(~too_wide).unionByName(written(_contexts(strings), "contexts"))
    listed = chosen.groupBy(F.col("row").alias("in")).agg(F.collect_list(F.struct("hash", "ctx", "n", "lo", "hi")).alias("listed"))
    shown = texts.join(listed, F.col("row") == F.col("in")).select("text", "listed").mapInArrow(tidy(_context_texts, length), "hash long, ctx long, n long, text binary")
    shards = shown.repartition(width, "hash").sortWithinPartitions("hash")
    repeats = written(shards.mapInArrow(tidy(_shards, length), "hash long, ctx long, n long, runs array<int>"), "repeats")
    every = repeats.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(repeats.where(F.col("n") * HOT >= every).select("hash", "ctx", "runs"))
    cold = repeats.where(F.col("n") * HOT < every).select("hash", "ctx", "runs")
    rest = found.join(hot, ["hash", "ctx"], "left_anti")
    places = found.join(hot, ["hash", "ctx"]).unionByName(rest.join(cold, ["hash", "ctx"]))
    by_text = places.groupBy(F.col("row").alias("in")).agg(F.collect_list(F.struct("lo", "count", "stride", "runs")).alias("places"))
    done = texts.join(by_text, F.col("row") == F.col("in"), "left").select("doc_id", "text", "places")
    kind = done.schema["doc_id"].dataType.simpleString()
    done = done.mapInArrow(tidy(_cut, length), f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "spans", "kept")
