"""N-gram Jaccard self-join: a blocked sparse matrix product with size-derived bounds.

Let A be the incidence matrix of documents by distinct word n-grams. Two
documents link when 100 * |X & Y| >= percent * |X | Y|; the links' connected
components are the classes. The product A * A' is never formed whole:

1. A is built batch by batch and dealt into column blocks (a range of n-gram
   hashes each) as packed arrays. N-grams that repeat within a batch of
   documents are collapsed to one entry there, so that a passage in a third
   of all documents adds one entry for each batch, not for each document.
2. A block keeps the columns that meet two or more documents. Back by batch,
   each document knows its count of shared n-grams. One with fewer than
   ceil(percent * size / 100) can't reach the bound with any partner and its
   rows are discarded here, which is most of A.
3. Equal sets become one row. Among the rest, row X takes part in the product
   only through its first shared - ceil(percent * |X| / 100) + 1 columns in
   hash order: a partner over the bound must meet it in one of them.
4. In each column the document with the fewest n-grams of its own is the pivot;
   every other document is multiplied, exactly, with the pivot that it meets in
   most columns. That joins families of copies in time linear in their size.
5. Only columns that still meet several components are multiplied further, and
   there only rows outside the largest component against the others, below
   bounds from sizes, positions and the parity of 256-bit column sketches
   (none of which can discard a link). What is left is verified exactly.

Words are known by keyed 128-bit digests. A set's size counts 128-bit digests of
n-grams; overlaps are counted over 64-bit ones. Row names are a task's and a
batch's number, so `docs` has to come in the same order whenever a lost task
runs again: from files or a checkpoint, not straight from a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import Batches, broadcast_if_small, checkpointed, column, join_hot, shuffle_width, slices, tidy, utf8
from .components import components
from .words import U, mix, windows, words

BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 64 << 20
_NONE = 0xFFFF
_ROWS = "block long, batch long, payload binary"
_DOCS = "uid long, doc_id long, n_shingles long, key string, grams binary"


def gram_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[np.ndarray], list[int]]:
    """The sorted distinct n-gram hashes of each row, and how many n-grams it has by 128-bit digests.

    A shorter row's whole sequence is its one n-gram.
    """
    rows = len(offsets) - 1
    found = words(raw, offsets)
    grams, first = windows(found.lanes[:, 0], found.row, width)
    other, _ = windows(found.lanes[:, 1], found.row, width)
    counts = found.counts(rows)
    bounds = np.searchsorted(found.row[first], np.arange(rows + 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    sets, sizes = [], []
    for k in range(rows):
        if 0 < counts[k] < width:
            whole = hashlib.blake2b(found.lanes[starts[k] : starts[k + 1]].tobytes(), digest_size=8).digest()
            sets.append(np.frombuffer(whole, U))
            sizes.append(1)
        else:
            own = slice(bounds[k], bounds[k + 1])
            sets.append(np.unique(grams[own]))
            sizes.append(max(len(sets[-1]), len(np.unique(other[own]))))  # a clash in one lane shows in the other
    return sets, sizes


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal neighbours."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _low(hashes: np.ndarray) -> bytes:
    """The low 56 bits of each hash; the block implies the rest."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _full(low: np.ndarray, top: int) -> np.ndarray:
    """Hashes from their low bytes."""
    whole = np.zeros((len(low) // 7, 8), np.uint8)
    whole[:, :7] = low.reshape(-1, 7)
    return whole.view(U).ravel() | U(top)


def _pack(rows: int, hashes: np.ndarray, index: np.ndarray, collapsed: np.ndarray) -> bytes:
    """Entries of one block and batch: their documents (as counts by document where that is shorter), their hashes, the collapsed columns."""
    order = np.argsort(index, kind="stable")
    counts = np.bincount(index, minlength=rows)
    listed = int(rows > 2 * len(hashes) or counts.max(initial=0) > 255)
    head = np.array([rows, listed, len(hashes)], np.uint32).tobytes()
    return head + (index[order].astype(np.uint16) if listed else counts.astype(np.uint8)).tobytes() + _low(hashes[order]) + _low(collapsed)


def _unpack(payload: bytes, top: int) -> tuple[np.ndarray, np.ndarray]:
    rows, listed, own = np.frombuffer(payload, np.uint32, 3).tolist()
    of = np.frombuffer(payload, np.uint16 if listed else np.uint8, own if listed else rows, 12)
    hashes = _full(np.frombuffer(payload, np.uint8, offset=12 + of.nbytes), top)
    index = np.full(len(hashes), _NONE, np.uint16)
    index[:own] = of if listed else np.repeat(np.arange(rows, dtype=np.uint16), of)
    return hashes, index


def _gathered(batches: Batches, most: int) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of rows that fill `most` bytes together, across Arrow batches, and fewer than 65,535 rows."""
    ids, texts, sizes, total = [], [], [], 0
    for batch in batches:
        own = batch.column(0).to_pandas().astype("Int64")
        raw, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, most):
            for c in range(a, b, _NONE):
                d = min(b, c + _NONE)
                size = int(offsets[d] - offsets[c])
                if ids and (total + size > most or sum(map(len, ids)) + d - c > _NONE):
                    yield pd.concat(ids), np.concatenate(texts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                    ids, texts, sizes, total = [], [], [], 0
                ids.append(own.iloc[c:d])
                texts.append(raw[offsets[c] : offsets[d]])
                sizes.append(np.diff(offsets[c : d + 1]))
                total += size
    if ids:
        yield pd.concat(ids), np.concatenate(texts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _incidence(width: int, bits: int, batches: Batches) -> Batches:
    """Rows by block; block -1 - batch carries a batch's documents and its own shared n-grams."""
    task = TaskContext.get().partitionId()
    most = min(64 << 20, max(BATCH_BYTES, (1 << bits) * 64))
    for serial, (ids, raw, offsets) in enumerate(_gathered(batches, most)):
        sets, sizes = [], []
        for a, b in slices(offsets, SLICE_BYTES):
            own = gram_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            sets += own[0]
            sizes += own[1]
        yield from _one((task << 24) + serial, ids, sets, sizes, bits)


def _one(name: int, ids: pd.Series, sets: list[np.ndarray], sizes: list[int], bits: int) -> Batches:
    seen: dict[tuple, int] = {}
    local = np.arange(len(sets))
    for k, s in enumerate(sets):
        if len(s):
            local[k] = seen.setdefault((sizes[k], hashlib.blake2b(s.tobytes(), digest_size=16).digest()), k)
    own = [k for k in range(len(sets)) if local[k] == k and len(sets[k])]
    blocks, payloads = [], []
    inner = b""
    if own:
        hashes = np.concatenate([sets[k] for k in own])
        index = np.repeat(np.array(own, np.uint16), [len(sets[k]) for k in own])
        order = np.argsort(hashes, kind="stable")
        hashes, index = hashes[order], index[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        many = ~fresh
        many[:-1] |= ~fresh[1:]
        inner = np.ascontiguousarray(hashes[many]).tobytes() + index[many].tobytes()
        own_hashes, own_index, collapsed = hashes[~many], index[~many], hashes[many & fresh]
        at, to = (h >> U(64 - bits) for h in (own_hashes, collapsed))
        found = np.union1d(at, to)
        cuts = [np.searchsorted(x, found, side) for x in (at, to) for side in ("left", "right")]
        for k, a, b, c, d in zip(found.tolist(), *cuts, strict=True):
            blocks.append(k)
            payloads.append(_pack(len(sets), own_hashes[a:b], own_index[a:b], collapsed[c:d]))
    head = np.zeros((len(sets), 3), np.int64)
    head[:, 0] = ids.fillna(0).to_numpy(np.int64)
    head[:, 1] = sizes
    head[:, 2] = local * 2 + ids.isna().to_numpy()
    blocks.append(-1 - name)
    payloads.append(len(sets).to_bytes(8, "little") + head.tobytes() + inner)
    yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array([name] * len(blocks), pa.int64()), pa.array(payloads, pa.binary())], ["block", "batch", "payload"])


def _shared(bits: int, table: pa.Table) -> pa.Table:
    """Of one column block: the entries of columns that meet two or more documents, by batch."""
    block = table.column("block")[0].as_py()
    if block < 0:
        return table.select(["block", "batch", "payload"])
    top = block << (64 - bits)
    names, hashes, index, of = table.column("batch").to_pylist(), [], [], []
    for k, payload in enumerate(table.column("payload")):
        h, i = _unpack(payload.as_py(), top)
        hashes.append(h)
        index.append(i)
        of.append(np.full(len(h), k, np.int32))
    hashes, index, of = map(np.concatenate, (hashes, index, of))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order]
    same = same[1:] == same[:-1]
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    order = order[many]
    order = order[index[order] != _NONE]
    order = order[np.argsort(of[order], kind="stable")]
    out = [(names[of[order[x]]], _low(hashes[order[x:y]]) + index[order[x:y]].tobytes()) for x, y in _runs(of[order])]
    return pa.table([pa.array([block] * len(out), pa.int64()), pa.array([n for n, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["block", "batch", "payload"])


def _gather(percent: int, bits: int, table: pa.Table) -> pa.Table:
    """Of one batch: its documents, with the shared n-grams of those that may reach the bound."""
    name, head, hashes, index = table.column("batch")[0].as_py(), None, [], []
    for block, payload in zip(table.column("block").to_pylist(), table.column("payload"), strict=True):
        payload = payload.as_py()
        if block < 0:
            n = int.from_bytes(payload[:8], "little")
            head = np.frombuffer(payload, np.int64, 3 * n, 8).reshape(-1, 3)
            payload = payload[8 + 24 * n :]
            n = len(payload) // 10
            hashes.append(np.frombuffer(payload, U, n))
            index.append(np.frombuffer(payload, np.uint16, n, 8 * n))
            continue
        n = len(payload) // 9
        hashes.append(_full(np.frombuffer(payload, np.uint8, 7 * n), block << (64 - bits)))
        index.append(np.frombuffer(payload, np.uint16, n, 7 * n))
    hashes, index = np.concatenate(hashes), np.concatenate(index)
    order = np.lexsort((hashes, index))
    hashes = np.ascontiguousarray(hashes[order])
    bounds = np.searchsorted(index[order], np.arange(len(head) + 1))
    uid, shared = (name << 16) + np.arange(len(head)), np.diff(bounds)
    may = (shared > 0) & (100 * shared >= percent * head[:, 1])
    grams = [hashes[bounds[k] : bounds[k + 1]].tobytes() if may[k] else None for k in range(len(head))]
    # Rows with the same set share a key: where all n-grams are shared, the hash of the set.
    keys = [hashlib.sha256(g).hexdigest() if g and shared[k] == head[k, 1] else str(uid[k]) for k, g in enumerate(grams)]
    keys = [keys[k] for k in head[:, 2] // 2]
    ids = pa.array(head[:, 0], mask=head[:, 2] % 2 == 1)
    return pa.table([pa.array(uid), ids, pa.array(head[:, 1]), pa.array(keys), pa.array(grams, pa.binary())], ["uid", "doc_id", "n_shingles", "key", "grams"])


def _prefixes(percent: int, batches: Batches) -> Batches:
    for batch in batches:
        uid, n, grams = (batch.column(k) for k in range(3))
        uid, n = np.asarray(uid), np.asarray(n)
        sets = [np.frombuffer(g.as_py(), np.int64) for g in grams]
        take = [len(s) - -(-percent * int(m) // 100) + 1 for s, m in zip(sets, n, strict=True)]
        if not take:
            continue
        rep = np.repeat(np.arange(len(sets)), take)
        size = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([np.arange(t, dtype=np.int64) for t in take])
        yield pa.record_batch([pa.array(np.concatenate([s[:t] for s, t in zip(sets, take, strict=True)])), pa.array(uid[rep]), pa.array((n - size)[rep]), pa.array(n[rep]), pa.array(size[rep] - at)], ["gram", "uid", "alone", "n", "left"])


def _overlaps(batches: Batches) -> Batches:
    """A block of the product: the entries of both sides by (pair, column); each column that both have adds one to the pair's overlap."""
    for batch in batches:
        entries, pairs = [], []
        for side in (2, 3):
            raw, offsets = utf8(batch.column(side))
            entries.append(np.frombuffer(raw, U))
            pairs.append(np.repeat(np.arange(len(batch)), np.diff(offsets) // 8))
        entry, pair = np.concatenate(entries), np.concatenate(pairs)
        order = np.lexsort((entry, pair))
        entry, pair = entry[order], pair[order]
        both = (entry[1:] == entry[:-1]) & (pair[1:] == pair[:-1])
        overlap = np.bincount(pair[1:][both], minlength=len(batch))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(4), pa.array(overlap)], ["a", "b", "sizes", "overlap"])


@F.pandas_udf(ArrayType(LongType()))
def _sketch(grams: pd.Series, bits: pd.Series) -> pd.Series:
    """Parity of the number of n-grams on each bit: |X ^ Y| is at least the number of bits that differ."""
    out = []
    for g, m in zip(grams, bits, strict=True):
        h = mix(np.frombuffer(g, U)) & U(m - 1)
        out.append(np.packbits((np.bincount(h.astype(np.int64), minlength=m) & 1).astype(np.uint8)).view(np.int64).tolist())
    return pd.Series(out)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact overlap reaches the bound.

    2048-bit sketches discard most others first, so that few sets are shuffled.
    """
    for side in "ab":
        facts = sets.select(F.col("uid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "alone", "wide")])
        pairs = pairs.join(facts, side)
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    apart = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    close = apart + F.col("alone_a") + F.col("alone_b") <= F.col("n_a") + F.col("n_b") - 2 * need
    pairs = checkpointed(pairs.where(close).select("a", "b"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = sets.join(broadcast_if_small(ends), "uid", "left_semi")
    x = sets.select(F.col("uid").alias("a"), F.col("grams").alias("x"), F.col("n").alias("nx"))
    y = sets.select(F.col("uid").alias("b"), F.col("grams").alias("y"), F.col("n").alias("ny"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("sizes"))
    done = both.mapInArrow(tidy(_overlaps), "a long, b long, sizes long, overlap long")
    return done.where((100 + percent) * F.col("overlap") >= percent * F.col("sizes")).select("a", "b", "overlap")


def _members(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Each document, and the shared n-grams of those that may link. Its own frames end with it, and so do their shuffle files."""
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    # Blocks of about BLOCK_BYTES of text: their number follows the data, and the session's partitions from below.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, (4 * shuffle_width(docs.sparkSession) - 1).bit_length(), (size // BLOCK_BYTES).bit_length())
    rows = texts.mapInArrow(tidy(_incidence, width, bits), _ROWS)
    kept = rows.groupBy("block").applyInArrow(lambda t: _shared(bits, t), _ROWS)
    return checkpointed(kept.groupBy("batch").applyInArrow(lambda t: _gather(percent, bits, t), _DOCS))


def _wide_bucket(n: Column) -> Column:
    """A bucket of sizes within a tenth of each other."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1.1)))


def _partner_buckets(percent: int) -> Column:
    """The size buckets of all partners that the row named _a can still reach the bound with."""
    low = F.lit(percent) * F.col("n_a") / 100
    high = F.least(F.lit(100) * F.col("n_a") / percent, F.col("left_a") * F.lit(100 + percent) / percent - F.col("n_a"))
    reach = F.sequence(_wide_bucket(F.ceil(low)), _wide_bucket(F.floor(high)))
    return F.when(F.floor(high) >= F.ceil(low), reach).otherwise(F.array().cast("array<bigint>"))


def _excess(percent: int) -> Column:
    """How far a row's own n-grams go beyond its half of what a link allows; the sum over a link's two rows is 0 at most."""
    return (100 + percent) * F.col("alone") - (100 - percent) * F.col("n")


def _bounds(percent: int) -> Column:
    """What sizes and places leave possible for the rows named _a and _b that meet in a column."""
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    return (F.least("left_a", "left_b") >= need) & (F.col("alone_a") + F.col("alone_b") <= F.col("n_a") + F.col("n_b") - 2 * need)


def ngram_jaccard_classes(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose n-gram sets link, directly or through others.

    Returns doc_id, n_shingles and component_id (the smallest id of the class),
    one row for each input row. Null, empty and blank texts have size 0 and
    link with nothing. Repeated rows are rows of their own and link by their
    equal texts. A null id is kept; its class takes the smallest id that isn't
    null, or null. Other columns are ignored, so their names can't clash. An
    empty table gives an empty table. percent lies in 1..100.
    """
    members = _members(docs, percent, width, id_col, text_col)
    classes = members.groupBy("key").agg(F.min(F.when(F.col("grams").isNotNull(), F.col("uid"))).alias("linkable"), F.min("uid").alias("least"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")).select("key", F.coalesce("linkable", "least").alias("class"), "least_id", "rows")
    sets = members.where("grams is not null").select("uid", F.col("n_shingles").alias("n"), "grams")
    sets = sets.join(classes.select(F.col("class").alias("uid")), "uid", "left_semi")
    alone = F.col("n") - (F.octet_length("grams") / 8).cast("long")
    sets = checkpointed(sets.withColumn("alone", alone).withColumn("sketch", _sketch("grams", F.lit(256))).withColumn("wide", _sketch("grams", F.lit(2048))))

    prefix = sets.select("uid", "n", "grams").mapInArrow(tidy(_prefixes, percent), "gram long, uid long, alone long, n long, left long")
    pivots = prefix.groupBy("gram").agg(F.min(F.struct("alone", "uid", "n", "left")).alias("p"), F.count("*").alias("rows")).where("rows > 1")
    pivots = pivots.select("gram", *[F.col(f"p.{c}").alias(f"{c}_b") for c in ("uid", "alone", "n", "left")])
    near = prefix.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("uid", "alone", "n", "left")]).join(pivots, "gram")
    met = near.where((F.col("uid_a") != F.col("uid_b")) & _bounds(percent)).groupBy("uid_a", "uid_b").agg(F.count("*").alias("columns"))
    # Each document is multiplied with the pivot that it meets most often; what that leaves apart, the open columns settle.
    pairs = checkpointed(met.groupBy(F.col("uid_a").alias("a")).agg(F.max_by("uid_b", F.struct("columns", -F.col("uid_b"))).alias("b")))
    links = checkpointed(_linked(pairs, sets, percent).select("a", "b"))
    first = components(links)

    # Columns that still meet several components.
    labelled = prefix.join(broadcast_if_small(first.select(F.col("node").alias("uid"), "label")), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    labelled = labelled.withColumn("excess", _excess(percent))
    sizes = labelled.groupBy("gram", "label").agg(F.count("*").alias("rows"), F.min("excess").alias("least"))
    mixed = sizes.groupBy("gram").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"), F.min("least").alias("least"), F.count("*").alias("labels")).where("labels > 1")
    # Rows that not even the best partner of their column can reach the bound with go before any pair is formed.
    open_rows = labelled.join(mixed.select("gram", "largest", "least"), "gram").where("excess + least <= 0").drop("excess", "least").join(sets.select("uid", "sketch"), "uid")
    open_rows = checkpointed(open_rows)
    one = open_rows.where("label <> largest").select("gram", *[F.col(c).alias(f"{c}_a") for c in ("uid", "label", "n", "left", "alone", "sketch")])
    one = one.withColumn("bucket_a", F.explode(_partner_buckets(percent)))
    two = open_rows.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("uid", "label", "n", "left", "alone", "sketch", "largest")], _wide_bucket(F.col("n")).alias("bucket_b"))
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(4)), F.lit(0))
    condition = (
        (one["gram"] == two["gram"])
        & (F.col("bucket_a") == F.col("bucket_b"))
        & (F.col("label_a") != F.col("label_b"))
        & ((F.col("label_b") == F.col("largest_b")) | (F.col("uid_a") < F.col("uid_b")))
        & _bounds(percent)
        & (apart + F.col("alone_a") + F.col("alone_b") <= F.col("n_a") + F.col("n_b") - 2 * need)
    )
    rest = checkpointed(one.join(two, condition).select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b")).distinct())
    more = checkpointed(_linked(rest, sets, percent).select("a", "b"))
    final = components(links.unionByName(more)) if not more.isEmpty() else first

    named = classes.join(final.withColumnRenamed("node", "class"), "class", "left").select("key", "rows", "least_id", F.coalesce("label", "class").alias("own"))
    smallest = named.groupBy("own").agg(F.min("least_id").alias("component_id"), F.count("*").alias("rows"))
    placed = join_hot(named, smallest, "own", "key").select("key", "rows", "component_id")
    return join_hot(members.select("doc_id", "uid", "n_shingles", "key"), placed, "key", "uid").select("doc_id", "n_shingles", "component_id")
