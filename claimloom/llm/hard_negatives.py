"""Hard negatives by norm-bucketed search.

Rows are dealt by norm into buckets, longest first, and written once. Anchors
are cut into groups and every group meets every bucket that it can't prune, in
some number of lanes: a lane is one task's stream of a group's anchors followed
by its buckets in descending norm. As |a| * |b| bounds an inner product, a
bucket goes unread by the anchors whose lower limit (that of their windows, or
their running k-th score) lies above |a| times the bucket's largest norm; whole
(group, bucket) pairs below the windows' limits go before the shuffle. Lanes
return at most k rows for each anchor and window, and a window function merges
them. One pass finds positives; the next, whose windows follow from the
positives' scores, finds negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, broadcast_if_small, ship, shuffle_width, spread, tidy, written

BUCKET_ROWS = 4096
GROUP_ANCHORS = 16_384
_CELLS = 1 << 20
_EXACT = 2.0**53
_LAST = np.iinfo(np.int64).max  # stands for a null id, which ties last
_NEVER = 1 << 62
_TASKS = 10_000
_BLOCKS = "group long, rows binary, ids binary, labels binary, vectors binary, lows binary, highs binary"
_BUCKETS = "top double, bucket long, rows binary, ids binary, labels binary, vectors binary"


def quantized(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """row, id, label, anchor, vector (floor(scale * x) of each component), norm; rows that can't take part are gone."""
    number = F.col(f"`{vector_col}`").cast("array<double>")
    broken = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(label.isNotNull() & F.col(f"`{vector_col}`").isNotNull() & ~F.coalesce(broken, F.lit(False)))
    whole = F.transform(number, lambda x: F.floor(x * F.lit(float(scale))))
    kept = kept.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(_LAST))).alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    return kept.withColumn("norm", F.sqrt(square)).withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.Array, fill: int = 0) -> np.ndarray:
    """Integer rows of a list column; shorter ones end in `fill`."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(column), int(sizes.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(matrix: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it."""
    most = int(np.abs(matrix).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    return np.array([*matrix.shape, np.dtype(kind).itemsize], np.int64).tobytes() + matrix.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    rows, columns, size = np.frombuffer(packed, np.int64, 3).tolist()
    return np.frombuffer(packed, f"i{size}", rows * columns, 24).reshape(rows, columns).astype(np.int64)


def _long(column: pa.Array) -> bytes:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()


def _pack(batches: Batches) -> Batches:
    """Buckets of up to BUCKET_ROWS neighbouring rows with their largest norm."""
    for batch in batches:
        for at in range(0, batch.num_rows, BUCKET_ROWS):
            part = batch.slice(at, BUCKET_ROWS)
            found = dict(zip(part.schema.names, part.columns, strict=True))
            top = float(np.max(found["norm"].to_numpy()))
            values = [top, int(found["row"][0].as_py()), *[_long(found[n]) for n in ("row", "id", "label")], _packed(_matrix(found["vector"]))]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(values, [pa.float64(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["top", "bucket", "rows", "ids", "labels", "vectors"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; a missing component counts as 0."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, width)
    if bound < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound >= 2.0**63:
        raise ValueError("an inner product of these vectors may exceed 64 bits")
    return a @ b.T


class _Best:
    """The k best (score, then smaller id) of each of n windows; `floor` is each one's running k-th score."""

    def __init__(self, n: int, k: int, low: np.ndarray) -> None:
        self.k, self.low, self.floor, self.last = k, low, low.copy(), np.full(n, _LAST)
        self.slot, self.score, self.id, self.row, self.more = *[np.zeros(0, np.int64) for _ in range(4)], []
        self.waiting = 0

    def add(self, slot: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of one window a row; only entries that beat the running k-th stay."""
        floor, last = self.floor[slot][:, None], self.last[slot][:, None]
        fits &= (scores > floor) | ((scores == floor) & (ids[None, :] <= last))
        crowded = np.flatnonzero(fits.sum(axis=1) > 4 * self.k)
        if len(crowded):  # entries below the block's own k-th score can't stay
            own = np.where(fits[crowded], scores[crowded], np.iinfo(np.int64).min)
            bound = np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k]
            fits[crowded] &= scores[crowded] >= bound[:, None]
        i, j = np.nonzero(fits)
        self.more.append((slot[i], scores[i, j], ids[j], rows[j]))
        self.waiting += len(i)
        if self.waiting > 4 * self.k * len(self.floor) or self.waiting > _CELLS:
            self.settle()

    def settle(self) -> None:
        slot, score, ids, rows = (np.concatenate(x) for x in zip((self.slot, self.score, self.id, self.row), *self.more, strict=True))
        order = np.lexsort((rows, ids, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        order, slot = order[keep], slot[keep]
        self.slot, self.score, self.id, self.row, self.more, self.waiting = slot, score[order], ids[order], rows[order], [], 0
        full = np.flatnonzero(np.arange(len(slot)) - np.searchsorted(slot, slot) == self.k - 1)
        self.floor[slot[full]], self.last[slot[full]] = self.score[full], self.id[full]


class _Lane:
    """One task's anchors of a group, and the best rows they have met."""

    def __init__(self, parts: list[tuple], k: int, same: bool) -> None:
        rows, ids, labels, vectors, lows, highs = zip(*parts, strict=True)
        self.rows, self.labels = np.concatenate(rows), np.concatenate(labels)
        width = max(v.shape[1] for v in vectors)
        self.vectors = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.windows = self.low.shape[1]
        # As long as float rounding of norms and their product can make it, and a little more.
        self.norm = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9
        self.same, self.best = same, _Best(self.low.size, k, self.low.ravel())

    def meet(self, top: float, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        floor = self.best.floor.reshape(self.low.shape).min(axis=1)
        active = np.flatnonzero(self.norm * top * (1 + 1e-9) >= floor)
        step = max(1, _CELLS // max(1, len(rows)))
        for at in range(0, len(active), step):
            own = active[at : at + step]
            scores = _products(self.vectors[own], vectors)
            alike = self.labels[own][:, None] == labels[None, :]
            alike = alike & (self.rows[own][:, None] != rows[None, :]) if self.same else ~alike
            for w in range(self.windows):
                fits = alike & (scores >= self.low[own, w][:, None]) & (scores <= self.high[own, w][:, None])
                self.best.add(own * self.windows + w, scores, fits, ids, rows)

    def result(self) -> pa.RecordBatch:
        self.best.settle()
        at, window = np.divmod(self.best.slot, self.windows)
        values = [self.rows[at], window, self.best.score, self.best.id, self.best.row]
        return pa.record_batch([pa.array(v, pa.int64()) for v in values], ["anchor", "place", "score", "id", "row"])


def _lanes(k: int, same: bool, batches: Batches) -> Batches:
    """A stream sorted by cell, kind (anchors first), then descending norm."""
    cell, waiting, lane = None, [], None
    for batch in batches:
        for r in batch.to_pylist():
            if r["cell"] != cell:
                if lane:
                    yield lane.result()
                cell, waiting, lane = r["cell"], [], None
            rows, ids, labels = (np.frombuffer(r[n], np.int64) for n in ("rows", "ids", "labels"))
            vectors = _wide(r["vectors"])
            if r["kind"] == 0:
                waiting.append((rows, ids, labels, vectors, _wide(r["lows"]), _wide(r["highs"])))
            elif waiting or lane:
                lane = lane or _Lane(waiting, k, same)
                lane.meet(r["top"], rows, ids, labels, vectors)
    if lane:
        yield lane.result()


def _blocks(batches: Batches) -> Batches:
    """Anchors with their windows, packed: a block for each group of an Arrow batch."""
    for batch in batches:
        groups = batch.column("group").to_numpy(zero_copy_only=False)
        for g in np.unique(groups).tolist():
            part = batch.take(pa.array(np.flatnonzero(groups == g)))
            found = dict(zip(part.schema.names, part.columns, strict=True))
            windows = [_packed(_matrix(found["lows"], _NEVER)), _packed(_matrix(found["highs"], -_NEVER))]
            values = [g, *[_long(found[n]) for n in ("row", "id", "label")], _packed(_matrix(found["vector"])), *windows]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(values, [pa.int64(), *[pa.binary()] * 6], strict=True)], ["group", "rows", "ids", "labels", "vectors", "lows", "highs"])


def _met(anchors: DataFrame, buckets: DataFrame, k: int, same: bool, groups: int, lanes: int) -> DataFrame:
    """(anchor, place, score, id, rank): each anchor's k best rows for each of its windows."""
    need = F.array_min("lows") / F.greatest(F.col("norm"), F.lit(1e-9)) * (1 - 1e-9)
    needs = anchors.groupBy("group").agg(F.min(need).alias("need"), F.max(F.array_min("lows") <= 0).alias("open"))
    blocks = anchors.select("group", "row", "id", "label", "vector", "lows", "highs").repartition(groups, "group").mapInArrow(tidy(_blocks), _BLOCKS)
    first = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    first = first.select((F.col("group") * lanes + F.col("lane")).alias("cell"), F.lit(None).cast("double").alias("top"), F.lit(0).alias("kind"), "rows", "ids", "labels", "vectors", "lows", "highs")
    none = F.lit(None).cast("binary")
    each = buckets.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    then = each.join(broadcast_if_small(needs), "group").where(F.col("open") | (F.col("top") >= F.col("need")))
    lane = F.pmod(spread(F.col("bucket"), "lane"), F.lit(lanes))
    then = then.select((F.col("group") * lanes + lane).alias("cell"), "top", F.lit(1).alias("kind"), "rows", "ids", "labels", "vectors", none.alias("lows"), none.alias("highs"))
    stream = first.unionByName(then).repartition(min(groups * lanes, max(lanes, _TASKS)), "cell").sortWithinPartitions("cell", "kind", F.desc("top"))
    found = stream.mapInArrow(tidy(_lanes, k, same), "anchor long, place long, score long, id long, row long")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("row")


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent * score / 100 rounded down, or up, in integers."""
    times = score * (-percent if up else percent)
    down = ((times - F.pmod(times, F.lit(100))) / 100).cast("long")
    return -down if up else down


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256) -> DataFrame:
    """The hardest negatives of each (anchor, positive) by integer inner product.

    A component x counts as floor(scale * x). An anchor's positives are its
    `positives` best other rows of the same label; negatives are the `negatives`
    best rows of another label with low_percent * positive_score <= 100 *
    negative_score <= high_percent * positive_score. Equal scores go by smaller
    id. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; a positive without a negative has no row.

    Rows with a null label, vector or component, or a component that isn't
    finite, take no part. Null ids tie last and are returned as null (so is the
    largest long). Rows that repeat an id are rows of their own: each is an
    anchor if its id says so, and may be a positive of its copies. A missing
    component of a shorter vector counts as 0. An empty table gives an empty
    one; products that may pass 64 bits are an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    rows = quantized(vectors, is_anchor, id_col, vector_col, F.col("label") if label is None else label, scale)
    dealt = rows.repartitionByRange(width, F.desc("norm"), spread(F.col("row"), "bucket")).sortWithinPartitions(F.desc("norm"), "id")
    rows = written(dealt, "norm-sorted")
    buckets = rows.select("norm", "row", "id", "label", "vector").mapInArrow(tidy(_pack), _BUCKETS)
    groups = max(1, -(-rows.where("anchor").count() // GROUP_ANCHORS))
    anchors = rows.where("anchor").withColumn("group", F.pmod(spread(F.col("row"), "group"), F.lit(groups)))
    whole = anchors.withColumns({"lows": F.array(F.lit(-_NEVER)), "highs": F.array(F.lit(_NEVER))})
    found = _met(whole, buckets, positives, True, groups, width)
    pairs = written(found.where("score >= 0").select("anchor", "rank", F.col("score").alias("positive_score"), F.col("id").alias("positive")), "positives")
    pairs = pairs.withColumns({"low": _share(F.col("positive_score"), low_percent, True), "high": _share(F.col("positive_score"), high_percent, False)})
    windows = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    limited = anchors.join(windows, anchors["row"] == windows["anchor"]).withColumns({"lows": F.col("w.low"), "highs": F.col("w.high")})
    limited = limited.select("group", "norm", "row", "id", "label", "vector", "lows", "highs")
    found = _met(limited, buckets, negatives, False, groups, width).withColumnRenamed("anchor", "of")
    named = pairs.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("own")), "anchor")
    met = found.join(named.withColumnRenamed("rank", "pair"), (F.col("of") == F.col("anchor")) & (F.col("place") + 1 == F.col("pair")))
    known = {n: F.when(F.col(c) < int(_LAST), F.col(c)) for n, c in (("anchor_id", "own"), ("positive_id", "positive"), ("negative_id", "id"))}
    return met.select(known["anchor_id"].alias("anchor_id"), known["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), known["negative_id"].alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
