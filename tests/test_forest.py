"""Forests grown in tasks, held against Spark ML's trees."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from claimloom.operators import forest, registry, scoring

COLUMNS = "f_charge double, f_age int, f_diagnoses int, f_lines int, target string"


def learnable(spark, n=3000):
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        charge, age, ill, lines = round(rng.gammavariate(2, 900), 2), rng.randint(18, 90), rng.randint(0, 6), rng.randint(0, 5)
        kind = (charge > 1500) + 2 * (age > 50) if rng.random() < 0.95 else rng.randint(0, 3)
        rows.append((charge, age, ill, lines, "abcd"[kind]))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("weights", [[1.0, 1.0, 1.0], [0.5, 2.0, 4.0]])
def test_a_tree_from_counts_is_spark_mls(spark, weights):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 30)), 5.0, float(rng.choice([0, 0, 0, 1, 7]))) for _ in range(900)]
    rows = [(*r, float((r[0] > 4) + (r[1] > 11 and r[3] > 0) if rng.random() < 0.7 else rng.randint(0, 2))) for r in rows]
    df = spark.createDataFrame([(*r, weights[int(r[4])]) for r in rows], "a double, b double, c double, d double, label double, w double")
    x = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="_x").transform(df).coalesce(1)
    points = forest.split_points(x, "_x", 4, 32)
    assert [len(p) for p in points] == [9, 30, 0, 2] and points[3] == [0.5, 4.0]
    cells = forest.with_cells(x, "_x", points)
    counts = cells.groupBy("_cell").agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in range(3)]).toPandas()
    bins = np.stack(np.unravel_index(counts["_cell"].to_numpy(), forest.sizes(points)), axis=1)
    tree = forest.grow_tree(bins, counts[["n0", "n1", "n2"]].to_numpy(), np.array(weights), 6, 3, 4, np.random.default_rng(1))
    model = DecisionTreeClassifier(labelCol="label", featuresCol="_x", weightCol="w", maxDepth=6, minInstancesPerNode=3).fit(x)
    assert len(tree["left"]) == model.numNodes > 9
    share = dict(zip(counts["_cell"], tree["votes"][forest.leaves(tree, bins)] / forest.WHOLE, strict=True))
    for r in model.transform(cells).select("_cell", "probability").distinct().collect():
        assert share[r["_cell"]] == pytest.approx(r["probability"].toArray(), abs=1e-9)


def test_split_points_deal_rows_to_all_bins(spark):
    df = spark.createDataFrame([(float(k * k), float(k % 40), 1.0 if k else float("-inf")) for k in range(3200)], "a double, b double, c double")
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(df)
    points = forest.split_points(x, "_x", 3, 32)
    assert [len(p) for p in points] == [31, 31, 0]
    dealt = np.stack(np.unravel_index([r[0] for r in forest.with_cells(x, "_x", points).select("_cell").collect()], forest.sizes(points)), axis=1)
    assert set(np.bincount(dealt[:, 0])) <= set(range(98, 103)) and set(np.bincount(dealt[:, 1])) <= {80, 160} and len(dealt) == 3200
    with pytest.raises(ValueError):
        forest.split_points(x.limit(0), "_x", 3, 32)


def test_the_default_forest_grows_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *args: pytest.fail("nodes on the driver"))
    model, rest = scoring.train(learnable(spark, 400), scoring.FEATURES, "target")
    nodes = model.stages[-1].nodes
    assert nodes.select("tree").distinct().count() == 150 and nodes.where("node = 0 and feature >= 0").count() == 150
    assert rest.count() == rest.where("prediction is not null").count() > 40


def test_a_grown_forest_foretells_like_spark_mls(spark, monkeypatch):
    x = learnable(spark)
    right = {}
    for most in (1 << 17, 0):
        monkeypatch.setattr(scoring, "MOST_NODES", most)
        model, rest = scoring.train(x, scoring.FEATURES, "target", trees=20, depth=8)
        labels = F.array(*[F.lit(s) for s in model.stages[0].labels])
        seen = rest.select((F.element_at(labels, (F.col("prediction") + 1).cast("int")) == F.col("target")).cast("int").alias("hit"), F.abs(F.aggregate(scoring.vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b) - 1).alias("off"))
        right[most] = seen.agg(F.avg("hit"), F.max("off"), F.count("*")).first()
    assert right[0][2] == right[1 << 17][2] and right[0][1] < 1e-9
    assert right[0][0] > 0.85 and abs(right[0][0] - right[1 << 17][0]) < 0.04


def test_grown_forests_repeat_and_are_kept(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scoring, "MOST_NODES", 0)
    x = learnable(spark, 600)
    models = [scoring.train(df, scoring.FEATURES, "target", trees=4, depth=6)[0] for df in (x, x.orderBy(F.desc("f_charge")).repartition(7))]
    first, again = (sorted(map(tuple, m.stages[-1].nodes.collect())) for m in models)
    assert first == again
    registry.save(models[0], spark, f"file://{tmp_path}", "a", None, scoring.FEATURES, {})
    loaded = registry.load(spark, f"file://{tmp_path}", "a")[0]
    old, new = (sorted(map(tuple, scoring.predict_filters(m, x).select(*scoring.FEATURES, "prediction", "confidence").collect())) for m in (models[0], loaded))
    assert old == new and len(old) == 600


def test_rows_that_no_grid_holds_go_to_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_NODES", 0)
    monkeypatch.setattr(forest, "MOST_CELLS", 10)
    model, _ = scoring.train(learnable(spark, 200), scoring.FEATURES, "target", trees=2, depth=3)
    assert model.stages[-1].getNumTrees == 2
