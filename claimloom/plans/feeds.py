"""Loads of files with broken lines, with their SQL: the lines are made from the tables by Spark, written as files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scoring
from ..session import shared_folder
from ..sources.quarantine import RVU, TRAINING, Feed, Feeds
from ..sources.testdata import Tables
from .oracle import sql
from .queries import query


def loaded(t: Tables, lines: DataFrame, feed: Feed) -> Feeds:
    """Writes raw lines (line string) as files with the feed's header and loads them."""
    folder = f"{shared_folder(t.spark)}/feeds-{uuid.uuid4().hex}"
    header = ",".join(c.split()[0] for c in feed.schema.split(", "))
    lines.select(F.col("line").alias(header)).write.csv(f"{folder}/files", header=True, sep="\u0001", quote="")  # no quoting: the lines stay as they are
    feeds = Feeds(t.spark, folder)
    feeds.load(f"{folder}/files", feed)
    return feeds


def report(feeds: Feeds, feed: Feed, value: Column) -> DataFrame:
    """What became of the lines: loaded rows with the sum of a value, and rejects by reason."""
    good = feeds.rows(feed).agg(F.count("*").alias("lines"), F.sum(value).cast("decimal(18,2)").alias("total")).select(F.lit("loaded").alias("what"), "lines", "total")
    bad = feeds.rejects(feed).groupBy(F.col("reason").alias("what")).agg(F.sum("n").alias("lines"), F.lit(None).cast("decimal(18,2)").alias("total"))
    return good.unionByName(bad)


_RVU = """ priced_parts AS (SELECT p_partkey AS k, (((round(p_retailprice * 100)::BIGINT + 50) // 100)::DECIMAL(18,0) * 0.01::DECIMAL(3,2))::DECIMAL(10,2) AS v FROM part WHERE p_size <> 13),
told AS (SELECT CASE WHEN k % 19 = 0 OR k % 23 = 0 THEN 'malformed' WHEN k % 17 = 0 THEN 'no_rvu_value' WHEN k % 29 = 0 THEN 'rvu_value_below_zero' WHEN k % 37 = 0 THEN 'contradicting_rows' ELSE 'loaded' END AS what, k, v,
  CASE WHEN k % 31 = 0 OR k % 37 = 0 THEN 2 ELSE 1 END AS n FROM priced_parts)"""


@query("rvu_load", sql("""SELECT what, sum(CASE WHEN what = 'loaded' THEN 1 ELSE n END)::BIGINT AS lines, sum(CASE WHEN what = 'loaded' THEN v END)::DECIMAL(18,2) AS total FROM told GROUP BY what
  UNION ALL SELECT 'repeated_row', count(*), NULL FROM told WHERE what = 'loaded' AND n = 2 HAVING count(*) > 0""", _RVU))
def rvu_load(t: Tables) -> DataFrame:
    """Prices with missing values, words for numbers, short lines, negative values, repeated and contradicting lines."""
    k = F.col("cpt_code").cast("long")
    each = t.rvu.select("cpt_code", k.alias("k"), "rvu_value").withColumn("copy", F.explode(F.when((k % 31 == 0) | (k % 37 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    other = F.when(F.col("k") % 37 == 0, F.col("rvu_value") + F.col("copy")).otherwise(F.col("rvu_value")).cast("decimal(10,2)").cast("string")
    value = F.when(F.col("k") % 17 == 0, "").when(F.col("k") % 29 == 0, F.concat(F.lit("-"), other)).otherwise(other)
    line = F.when(F.col("k") % 19 == 0, F.concat_ws(",", "cpt_code", F.lit("Code"), F.lit("unknown"))).when(F.col("k") % 23 == 0, F.col("cpt_code")).otherwise(F.concat_ws(",", "cpt_code", F.lit("Code"), value))
    return report(loaded(t, each.select(line.alias("line")), RVU), RVU, F.col("rvu_value").cast("decimal(10,2)"))


_TRAINING = " told AS (SELECT CASE WHEN k % 19 = 0 THEN 'malformed' WHEN k % 13 = 0 THEN 'no_target' WHEN k % 17 = 0 THEN 'charge_below_zero' ELSE 'loaded' END AS what, f_lines FROM (SELECT *, claim_id::BIGINT AS k FROM gated))"


@query("training_load", sql("SELECT what, count(*) AS lines, sum(CASE WHEN what = 'loaded' THEN f_lines END)::DECIMAL(18,2) AS total FROM told GROUP BY what", _TRAINING))
def training_load(t: Tables) -> DataFrame:
    """Training lines of every claim, some without a target, with a charge below zero or with a field too many."""
    x = scoring.formula_predictions(scoring.features(t.claims, t.lines, t.diagnoses)).withColumn("k", F.col("claim_id").cast("long"))
    charge, age, diagnoses, lines = (F.col(c).cast("string") for c in scoring.FEATURES)
    target = F.when(F.col("k") % 13 == 0, "").otherwise(F.concat(F.lit("F"), F.col("prediction").cast("string")))
    line = F.concat_ws(",", "claim_id", F.when(F.col("k") % 17 == 0, F.lit("-1")).otherwise(charge), age, diagnoses, lines, target, F.when(F.col("k") % 19 == 0, F.lit("more")))
    return report(loaded(t, x.select(line.alias("line")), TRAINING), TRAINING, F.col("num_line_items"))
