"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Returns (node, label), label being the smallest node that the links (a, b) reach.

    Nodes are longs. Self links and repeated links are allowed, null ends are
    ignored. Each round is written to the shared checkpoint folder.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        near = edges.join(low, "u")
        edges = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        edges = checkpointed(edges.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
