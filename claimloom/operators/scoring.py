"""Features, predictions and the confidence gate; training with Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from ..session import written
from . import forest

FEATURES = ["f_charge", "f_age", "f_diagnoses", "f_lines"]
MOST_NODES = 1 << 17  # that Spark ML may have to grow on the driver
ROWS_A_TASK, MOST_TASKS = 10_000, 200  # of training; every task sends the counts of all nodes of a pass


def features(claims: DataFrame, lines: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """claim_id and the four features; an age of null or 0 counts as 30, a missing charge as 0."""
    n_lines = lines.groupBy("claim_id").agg(F.count("*").alias("f_lines"))
    n_ill = diagnoses.groupBy("claim_id").agg(F.count("*").alias("f_diagnoses"))
    x = claims.select("claim_id", F.coalesce(F.col("total_charge").cast("double"), F.lit(0.0)).alias("f_charge"), F.coalesce(F.nullif("patient_age", F.lit(0)), F.lit(30)).cast("int").alias("f_age"))
    return x.join(n_ill, "claim_id", "left").join(n_lines, "claim_id", "left").na.fill(0, ["f_diagnoses", "f_lines"])


def formula_predictions(feats: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: class and confidence from the features alone."""
    score = (F.col("f_age") * 7 + F.col("f_diagnoses") * 13 + F.col("f_lines") * 3 + F.floor("f_charge")) % 100
    return feats.withColumn("prediction", (score % 4).cast("int")).withColumn("confidence", (F.lit(50.0) + score / F.lit(2.0)) / F.lit(100.0))


def gate(predicted: DataFrame, params: Params = Params()) -> DataFrame:
    """The assigned filter; low confidence and failed predictions get the fallback ones."""
    failed, low = F.col("prediction").isNull(), F.coalesce("confidence", F.lit(0.0)) < params.ml_threshold
    name = F.when(failed, "FILTER_ML_ERROR").when(low, "FILTER_ML_LOW_CONFIDENCE_FALLBACK").otherwise(F.concat(F.lit("ML_FILTER_"), F.col("prediction").cast("string")))
    return predicted.withColumn("assigned_filter", name).withColumn("confidence", F.when(failed, 0.0).otherwise(F.col("confidence"))).withColumn("fallback", failed | low)


def exact_quantile(df: DataFrame, column: str, share: float, buckets: int = 4096) -> float | None:
    """The exact interpolated quantile of a column, without its rows in one task; None without values.

    Each pass counts the values of a range in `buckets` parts (a few thousand
    rows for the driver) and goes on with the part that holds the rank, until
    that is a single value: three or four passes for most data.
    """
    own = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = (n - 1) * share
    first, second = (_ranked(own, int(k), low, high, buckets) for k in (rank // 1, -(-rank // 1)))
    return first + (second - first) * (rank - rank // 1)


def _ranked(own: DataFrame, rank: int, low: float, high: float, buckets: int) -> float:
    """The value with so many values before it, between low and high."""
    while low < high:
        part = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * buckets), F.lit(buckets - 1))
        counts = own.where(F.col("v").between(low, high)).groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("p").collect()
        for r in counts:
            if rank < r.n:
                low, high = r.a, r.b
                break
            rank -= r.n
    return low


def most_frequent(df: DataFrame, column: str) -> str | None:
    """The value that most rows have, the smallest of equals; None without values."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(1).collect()
    return top[0][0] if top else None


def impute(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Nulls filled by the exact median and the mode (ties: smallest); UNKNOWN where a column has no value, 0 or UNKNOWN where it is absent."""
    for c in numeric:
        df = df if c in df.columns else df.withColumn(c, F.lit(0.0))
    for c in categorical:
        df = df if c in df.columns else df.withColumn(c, F.lit("UNKNOWN"))
    values = {c: exact_quantile(df, c, 0.5) or 0.0 for c in numeric} | {c: most_frequent(df, c) or "UNKNOWN" for c in categorical}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if c in numeric else F.col(c), F.lit(v)) for c, v in values.items()})


def train(df: DataFrame, features: list[str], label: str, trees: int = 150, depth: int = 20, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A random forest on an 80/20 split stratified by label, with class weights balanced over the training part.

    Rows are dealt by a hash of features and label; each class is cut at its own
    quantile of that hash, so that every class gives 80 % of its rows (approximately,
    and exactly equal rows to the same part). Returns the model and its predictions
    on the rest.

    The rows are written once, as the fit passes over them again and again, and
    dealt to tasks by their number and hash alone: the same rows make the same
    forest on any cluster. Each row's node in each tree is kept beside it, so no
    pass sends the trees to the tasks or walks them from the root.

    Spark ML grows the nodes of all trees on the driver, from counts that every
    task sends for every node. A forest that may have more than MOST_NODES is
    grown in tasks, if the features' bins make a grid that a task can hold. Cuts
    and split points are sketched quantiles, which may differ a little where many
    values come in another order.
    """
    keyed = written(df.withColumn("_part", F.xxhash64(F.lit(seed), *features, label)), "forest")
    cuts = written(keyed.groupBy(label).agg(F.percentile_approx("_part", F.lit(0.8), F.lit(10_000)).alias("_cut")), "forest-cuts")
    dealt = keyed.join(cuts, label).withColumn("_train", F.col("_part") <= F.col("_cut")).drop("_cut")
    counts = dealt.where("_train").groupBy(label).agg(F.count("*").alias("_n"))  # one row for each class
    every = Window.partitionBy()
    weights = written(counts.select(label, (F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))).alias("_w")), "forest-weights")
    weighed = dealt.join(weights, label)
    own, rest = weighed.where("_train"), weighed.where("not _train").drop("_part")
    front = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"), VectorAssembler(inputCols=features, outputCol="_x")]).fit(own)
    wanted = RandomForestClassifier(labelCol="_label", featuresCol="_x", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, seed=seed, cacheNodeIds=True)
    points = forest.split_points(front.transform(own), "_x", len(features), wanted.getMaxBins()) if trees << depth > MOST_NODES else None
    if points and math.prod(forest.sizes(points)) <= forest.MOST_CELLS:
        by_class = [r["_w"] for r in front.stages[0].transform(weights).orderBy("_label").collect()]
        grown = forest.grow(front.transform(own), points, by_class, wanted)
    else:
        parts = min(keyed.count() // ROWS_A_TASK + 1, MOST_TASKS)
        grown = wanted.fit(front.transform(own.repartition(parts, "_part").sortWithinPartitions("_part", *features).drop("_part")))
    model = PipelineModel([*front.stages, grown])
    return model, model.transform(rest)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """prediction (class index) and confidence (its probability)."""
    stages = PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)])  # rows to predict have no label
    p = vector_to_array("probability")
    return stages.transform(df).select("*", F.array_max(p).alias("confidence")).withColumn("prediction", F.col("prediction").cast("int"))


def predict_filters(model: PipelineModel, df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """The rows with prediction, confidence and predicted_filter; one with a null feature gets no class, confidence 0 and ERROR_PREDICTION."""
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    flagged = df.withColumn("_known", known)
    filled = predict(model, flagged.na.fill(0, features))
    name = F.when(F.col("_known"), F.concat(F.lit("ML_FILTER_"), F.col("prediction").cast("string"))).otherwise("ERROR_PREDICTION")
    return filled.select(*df.columns, F.when(F.col("_known"), F.col("prediction")).alias("prediction"), F.when(F.col("_known"), F.col("confidence")).otherwise(0.0).alias("confidence"), name.alias("predicted_filter"))


def summary(classes: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 from class_report."""
    p, r, n = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0)), F.col("support")
    f1 = F.coalesce(F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return classes.agg((F.sum(r * n) / F.sum(n)).alias("accuracy"), (F.sum(f1 * n) / F.sum(n)).alias("weighted_f1"))


def class_report(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and support of each class, from one pass of counts."""
    names = predictions.select(F.col(label).alias("class"), F.lit(1).alias("is_label"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")).unionByName(predictions.select(F.col(predicted).alias("class"), F.lit(0).alias("is_label"), F.lit(0).alias("hit")))
    sums = names.groupBy("class").agg(F.sum("is_label").alias("support"), F.sum("hit").alias("hits"), F.sum(1 - F.col("is_label")).alias("predicted"))
    return sums.select("class", "support", (F.col("hits") / F.nullif("predicted", F.lit(0))).alias("precision"), (F.col("hits") / F.nullif("support", F.lit(0))).alias("recall"))
