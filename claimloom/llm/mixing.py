"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets: sources in code-point order (null last) take the weights in turn and
share the words of all documents; a target stops at `most` times its source's
size and the excess is shared again by weight (water filling, closed form over
the small table of sources).

Order: each source has a schedule of relative weights at evenly spaced moments,
linear between them. Its integral is the source's cumulative demand; inverting
it at a document's place in its source gives the moment of training at which
the document is due. Documents are range-sorted by that moment.

A source is read in passes: whole passes over all its documents, then documents
in digest order until the target is met, the last of them in part. So each
source's words meet its target to within a word, and no document is taken more
than `most` times. Running sums are split by digest buckets, so a source with a
third of all rows is no single group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column

#: Relative weight at even moments from the start to the end of training, in turn as the weights are.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def with_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(id, source, size, row): size counts words, row holds all columns if they are carried."""
    row = F.struct(*[column(c).alias(c) for c in docs.columns]) if carry else F.lit(None).cast("struct<unused:int>")
    size = F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(column(id_col).alias("id"), column(source_col).alias("source"), size.alias("size"), row.alias("row"))


def targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, rank, source_size, target) for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    levels = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("words_left"),
        F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    ).withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight"))
    share = F.max(F.when(~F.col("capped"), F.col("words_left").cast("double") / F.col("weight_left"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share * F.col("weight"))
    return levels.select("source", "rank", "source_size", target.alias("target"))


def moment(demand: Column, rank: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """When, in 0..1, a source's cumulative demand reaches the fraction `demand` of all it will take."""

    def inverse(knots: Sequence[float]) -> Column:
        steps = len(knots) - 1
        areas = [(a + b) / (2 * steps) for a, b in zip(knots, knots[1:], strict=False)]
        area = demand * F.lit(float(sum(areas)))
        out, before = None, 0.0
        for k, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            v = area - F.lit(before)
            x = F.lit(k / steps) + F.lit(2.0) * v / (F.lit(float(a)) + F.sqrt(F.lit(float(a * a)) + F.lit(2.0 * (b - a) * steps) * v))
            out = x if out is None else F.when(area < F.lit(before), out).otherwise(x)
            before += areas[k]
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))

    found = inverse(schedules[-1])
    for k in range(len(schedules) - 2, -1, -1):
        found = F.when(rank % len(schedules) == k, inverse(schedules[k])).otherwise(found)
    return found


def mix_sources(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, schedules: Sequence[Sequence[float]] = SCHEDULES, digits: int = 3) -> DataFrame:
    """Takes the result of with_sizes; adds source_size, target, taken, passes, due.

    taken counts words, repeats included; due holds the moment of each pass.
    Null texts and texts without words have size 0, are taken 0 times and have
    no moment. Null sources form one source. Null ids and repeated rows are rows
    of their own; equal rows are interchangeable. An empty table gives an empty
    table. digits: hexadecimal digits of the digest that split a source's sums.
    """
    facts = targets(sized, weights, most).withColumn("name", _name("source"))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    rows = sized.withColumn("name", _name("source")).withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, digits))
    sums = rows.groupBy("name", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("name").orderBy("bucket")) - F.col("bucket_size")
    starts = sums.select("name", "bucket", before.alias("before")).join(facts.drop("source"), "name")
    inner = Window.partitionBy("name", "bucket").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, ["name", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(inner) - F.col("size"))

    words = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("whole", whole)
    extra = words - F.col("whole") * F.col("source_size") - F.col("start")
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(extra, F.col("size"))).cast("long"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    passes = F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("taken", taken).withColumn("passes", passes)
    middle = F.col("start") + F.lit(0.5) * F.when(F.col("whole") > 0, F.col("size")).otherwise(F.col("part"))
    every = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda k: moment((k * F.col("source_size") + middle) / F.col("target"), F.col("rank"), schedules))
    placed = placed.withColumn("due", F.when(F.col("passes") > 0, every).otherwise(F.array().cast("array<double>")))
    return placed.select("id", "source", "size", "row", "source_size", "target", "whole", "part", "taken", "passes", "due")


def _name(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column)))
