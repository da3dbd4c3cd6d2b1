"""Random forests of many nodes: rows are counted by cell of binned features, and tasks grow the trees from these counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

MOST_CELLS = 1 << 20  # of the grid of all features' bins; a task holds one tree's cells
WHOLE = 1 << 40  # a leaf's votes; whole numbers add up alike in any order


def split_points(rows: DataFrame, column: str, width: int, bins: int) -> list[list[float]]:
    """Each feature's split points: between its values where they fit the bins, else quantiles that deal the rows to the bins."""
    x, names = vector_to_array(column), [f"_x{i}" for i in range(width)]
    own = rows.select(*[x[i].alias(c) for i, c in enumerate(names)])
    ranks = [k / bins for k in range(1, bins)]
    seen = own.agg(*[F.struct(F.min(c).alias("least"), F.approx_count_distinct(c).alias("values"), F.percentile_approx(c, ranks, 10_000).alias("cuts")).alias(c) for c in names]).first()
    if seen[names[0]]["least"] is None:
        raise ValueError("no rows to train on")
    few = [c for c in names if seen[c]["values"] <= 2 * bins]
    sets = own.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    points = []
    for c in names:
        values = sorted(sets[c]) if c in few else []
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] if c in few and len(values) <= bins else set(seen[c]["cuts"]) - {seen[c]["least"]}
        points.append(sorted({v for v in cuts if math.isfinite(v)}))
    return points


def with_cells(df: DataFrame, column: str, points: list[list[float]]) -> DataFrame:
    """df and the number of each row's cell, whose digits are the features' bins."""
    x, number = vector_to_array(column), F.lit(0)
    wide = df.withColumns({f"_x{i}": x[i] for i in range(len(points))})
    edges = [[-math.inf, *(p or [0.0]), math.inf] for p in points]
    binned = Bucketizer(splitsArray=edges, inputCols=[f"_x{i}" for i in range(len(points))], outputCols=[f"_b{i}" for i in range(len(points))]).transform(wide)
    for i, size in enumerate(sizes(points)):
        number = number * size + F.col(f"_b{i}").cast("int")
    return binned.select(*df.columns, number.alias("_cell"))


def sizes(points: list[list[float]]) -> list[int]:
    return [max(len(p), 1) + 1 for p in points]


def _bins(cells: pd.Series, points: list[list[float]]) -> np.ndarray:
    return np.stack(np.unravel_index(cells.to_numpy(), sizes(points)), axis=1)


def _gini(votes: np.ndarray) -> np.ndarray:
    total = votes.sum(axis=1)
    impurity = np.ones(len(votes))
    for share in (votes / np.where(total > 0, total, 1)[:, None]).T:
        impurity -= share * share
    return impurity


def _best_splits(bins: np.ndarray, counts: np.ndarray, at: np.ndarray, total: np.ndarray, chosen: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's feature (-1: none gains) and last bin on the left: the most gain among its chosen features, the first of equals."""
    gain, feature, last = np.zeros(len(total)), np.full(len(total), -1), np.zeros(len(total), np.int64)
    before, impurity = total.cumsum(axis=0) - total, _gini(total * weights)
    for own in chosen.T:
        b = bins[np.arange(len(at)), own[at]]
        order = np.argsort(at * (bins.max() + 1) + b)  # rows of one bin in any order
        node, b = at[order], b[order]
        ends = np.flatnonzero(np.append((node[1:] != node[:-1]) | (b[1:] != b[:-1]), True))
        node, b = node[ends], b[ends]
        left = counts[order].cumsum(axis=0)[ends] - before[node]
        right = total[node] - left
        a, z = left * weights, right * weights
        both = a.sum(axis=1) + z.sum(axis=1)
        gains = impurity[node] - a.sum(axis=1) / both * _gini(a) - z.sum(axis=1) / both * _gini(z)
        gains[(left.sum(axis=1) < least) | (right.sum(axis=1) < least)] = -np.inf
        top = np.maximum.reduceat(gains, np.flatnonzero(np.append(True, node[1:] != node[:-1])))
        hits = np.flatnonzero(gains == top[node])
        place = hits[np.unique(node[hits], return_index=True)[1]]
        more = top > gain
        gain[more], feature[more], last[more] = top[more], own[more], b[place[more]]
    return feature, last


def grow_tree(bins: np.ndarray, counts: np.ndarray, weights: np.ndarray, depth: int, least: int, subset: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree, level by level, from the drawn counts of rows by cell and class, as Spark ML grows it.

    Of a node: its feature (-1: a leaf), the last bin that goes left, its left
    child (the right one is the next) and its votes by class. A split leaves
    `least` drawn rows on either side. Two leaves of one prediction are merged.
    """
    levels, base, at = [], 0, np.zeros(len(bins), np.int64)
    for level in range(depth + 1):
        m = len(levels[-1][3]) * 2 if levels else 1
        if not m:
            break
        total = np.stack([np.bincount(at, c, m) for c in counts.T], axis=1).astype(np.int64)
        feature, last = np.full(m, -1), np.zeros(m, np.int64)
        if level < depth and len(at):
            chosen = np.sort(np.argsort(rng.random((m, bins.shape[1])), axis=1)[:, :subset], axis=1)
            feature, last = _best_splits(bins, counts, at, total, chosen, weights, least)
        inner = np.flatnonzero(feature >= 0)
        child = np.full(m, -1)
        child[inner] = 2 * np.arange(len(inner))
        levels.append((feature, last, np.where(child >= 0, base + m + child, -1), base + inner, total * weights))
        on = feature[at] >= 0
        at, bins, counts = at[on], bins[on], counts[on]
        at = child[at] + (bins[np.arange(len(at)), feature[at]] > last[at])
        base += m
    feature, last, left, votes = (np.concatenate([x[k] for x in levels]) for k in (0, 1, 2, 4))
    guess, met = votes.argmax(axis=1), np.zeros(base, bool)
    for *_, inner, _ in reversed(levels):
        kids = left[inner]
        one = inner[(feature[kids] < 0) & (feature[kids + 1] < 0) & (guess[kids] == guess[kids + 1])]
        feature[one], left[one] = -1, -1
    met[0] = True
    for *_, inner, _ in levels:
        kids = left[inner[met[inner] & (feature[inner] >= 0)]]
        met[kids] = met[kids + 1] = True
    number = met.cumsum() - 1
    share = votes / np.maximum(votes.sum(axis=1), np.finfo(float).tiny)[:, None]
    return {"feature": feature[met], "bin": last[met], "left": np.where(feature[met] < 0, -1, number[left[met]]), "votes": np.rint(share[met] * WHOLE).astype(np.int64)}


def leaves(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The leaf of each cell."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (inner := tree["feature"][at] >= 0).any():
        at = np.where(inner, tree["left"][at] + (bins[rows, tree["feature"][at]] > tree["bin"][at]), at)
    return at


def grow(rows: DataFrame, points: list[list[float]], weights: list[float], forest: RandomForestClassifier) -> GrownForest:
    """The forest that the classifier describes, over rows whose classes have the given weights.

    A bootstrap takes each row as often as a Poisson number of mean 1 says, as
    Spark ML's does; the rows of a class in a cell are taken as often as one of
    their number says, which is the sum of theirs. So a tree needs the counts
    alone, and the work of growing is bounded by the grid, not by the rows.
    """
    spark = rows.sparkSession
    ship(spark)
    classes, trees, depth, least, seed = [f"n{c}" for c in range(len(weights))], forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSeed() & ((1 << 64) - 1)
    subset = len(points) if trees == 1 else math.ceil(math.sqrt(len(points)))
    counted = with_cells(rows, forest.getFeaturesCol(), points).groupBy("_cell").agg(*[F.count_if(F.col(forest.getLabelCol()) == c).alias(n) for c, n in enumerate(classes)])
    cells = written(counted.repartition(spark.sparkContext.defaultParallelism, "_cell"), "forest-cells")

    def tree(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own, rng = own.sort_values("_cell"), np.random.default_rng([seed, int(key[0])])
        drawn = rng.poisson(own[classes].to_numpy())
        some = drawn.any(axis=1)
        grown = grow_tree(_bins(own["_cell"][some], points), drawn[some], np.array(weights), depth, least, subset, rng)
        votes = {f"v{c}": v for c, v in enumerate(grown.pop("votes").T)}
        return pd.DataFrame({"tree": int(key[0]), "node": np.arange(len(grown["left"]))} | grown | votes)

    schema = "tree int, node int, feature int, bin int, left int" + "".join(f", v{c} long" for c in range(len(classes)))
    nodes = written(_by_lot(cells, trees).groupBy("lot").applyInPandas(tree, schema), "forest-nodes")
    return GrownForest(nodes, featuresCol=forest.getFeaturesCol(), points=points, trees=trees, classes=len(classes))


def _by_lot(cells: DataFrame, lots: int) -> DataFrame:
    """All cells for each lot."""
    return cells.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).repartition(lots, "lot")


class GrownForest(Model, MLWritable, MLReadable):
    """A forest whose nodes are a table; rows of one cell get one prediction, from the mean of the trees' shares of classes."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of the features", TypeConverters.toString)
    points = Param(Params._dummy(), "points", "split points of each feature", TypeConverters.identity)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    def __init__(self, nodes: DataFrame | None = None, **params: object):
        super().__init__()
        self.nodes = nodes
        self._set(**params)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        points, trees, names = self.getOrDefault("points"), self.getOrDefault("trees"), [f"v{c}" for c in range(self.getOrDefault("classes"))]
        placed = with_cells(df, self.getOrDefault("featuresCol"), points)

        def vote(nodes: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            bins, votes = _bins(cells["_cell"], points), np.zeros((len(cells), len(names)), np.int64)
            for _, own in nodes.sort_values("node").groupby("tree"):
                votes += own[names].to_numpy()[leaves({c: own[c].to_numpy() for c in ("feature", "bin", "left")}, bins)]
            return pd.DataFrame({"_cell": cells["_cell"].to_numpy()} | dict(zip(names, votes.T, strict=True)))

        cores = df.sparkSession.sparkContext.defaultParallelism
        lots = min(trees, 2 * cores)  # trees that vote in one task send one row for each cell
        cells = _by_lot(placed.select("_cell").distinct().repartition(cores, "_cell"), lots)
        nodes = self.nodes.withColumn("lot", F.col("tree") % lots).repartition(lots, "lot")
        voted = nodes.groupBy("lot").cogroup(cells.groupBy("lot")).applyInPandas(vote, "_cell int" + "".join(f", {c} long" for c in names))
        sums = voted.groupBy("_cell").agg(F.array(*[F.sum(c) for c in names]).alias("_votes"))
        raw = F.transform("_votes", lambda v: v / F.lit(float(WHOLE)))
        share = F.transform("_votes", lambda v: v / F.aggregate("_votes", F.lit(0).cast("long"), lambda a, b: a + b))
        return placed.join(sums, "_cell").select(*df.columns, array_to_vector(raw).alias("rawPrediction"), array_to_vector(share).alias("probability"), (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias("prediction"))

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader(cls)


class ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.nodes.write.parquet(f"{path}/nodes")


class ForestReader(DefaultParamsReader):
    def load(self, path: str) -> GrownForest:
        forest = super().load(path)
        forest.nodes = self.sparkSession.read.parquet(f"{path}/nodes")
        return forest
