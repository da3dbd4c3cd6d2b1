"""An inverted index over claims: stemmed terms, postings coded by gaps, refreshed by blocks of claims.

A posting list is cut into blocks of claims, so that a term that every claim
holds is spread over as many rows as there are blocks, and a refresh writes the
blocks of the touched claims again and no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stems import STOP, stem

BLOCK = 65_536
PLACES_A_TASK = 1_000_000


def terms(columns: Sequence[str | Column]) -> Column:
    """The distinct words of the columns, lower-cased, without stop words; not stemmed yet."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP)))


def postings(rows: DataFrame, key: str, columns: Sequence[str | Column]) -> DataFrame:
    """term, block, n, gaps: the block's claims that hold the term, first as its place in the block, then as steps.

    Claims are dealt by block before their words are taken apart, about a block
    to a task, so that all of a list is made where its claims are: no task holds
    more words than those of a few blocks, and no word that many claims share
    meets in one task. A word is stemmed once for each block. key is a number
    that is not negative.
    """
    own = rows.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("long")).withColumn("block", F.floor(F.col("_key") / BLOCK))
    size = own.agg(F.count_distinct("block"), F.count("*")).first()
    own = own.repartition(2 * min(size[0], size[1] // BLOCK + 1) + 1, "block")
    each = own.select("block", (F.col("_key") % BLOCK).alias("place"), F.explode(terms(columns)).alias("word"))
    by_word = each.groupBy("block", "word").agg(F.collect_list("place").alias("own"))
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("places")  # at most a block's claims
    lists = by_word.select("block", stem(F.col("word")).alias("term"), "own").groupBy("block", "term").agg(places)
    steps = F.zip_with("places", F.concat(F.array(F.lit(0).cast("long")), F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0)))), lambda a, b: a - b)
    return lists.select("term", "block", F.size("places").cast("long").alias("n"), steps.cast("array<int>").alias("gaps"))


def places(found: DataFrame) -> DataFrame:
    """term, block, place: postings read back, a place is the sum of the steps up to it.

    Lists are dealt while they are short rows, by as many tasks as their places need.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    dealt = found.select("term", "block", "gaps").repartition(total // PLACES_A_TASK + 1, "term", "block")
    own = dealt.select("term", "block", F.posexplode("gaps").alias("at", "gap"))
    upto = Window.partitionBy("term", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("term", "block", F.sum("gap").over(upto).alias("place"))


def keys(found: DataFrame) -> DataFrame:
    """term, key: postings read back."""
    return places(found).select("term", (F.col("block") * BLOCK + F.col("place")).alias("key"))


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, rows: DataFrame, key: str, columns: Sequence[str | Column]) -> None:
        self._write(postings(rows, key, columns), "static")

    def refresh(self, rows: DataFrame, touched: DataFrame, key: str, columns: Sequence[str | Column]) -> None:
        """Blocks that hold a touched claim, made again from the rows as they are now; touched has the key."""
        blocks = touched.select(F.floor(F.col(key) / BLOCK).alias("_block")).distinct()
        own = rows.join(blocks, F.floor(F.col(key) / BLOCK) == F.col("_block"), "left_semi")
        self._write(postings(own, key, columns), "dynamic")

    def _write(self, found: DataFrame, mode: str) -> None:
        found.sortWithinPartitions("block", "term").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("block").parquet(self.folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema("term string, n long, gaps array<int>, block long").parquet(self.folder)

    def search(self, *words: str) -> DataFrame:
        """key of every claim that holds all the words; only their posting lists are read (a filter on term that the files' statistics serve)."""
        asked = self.spark.createDataFrame([(w.lower(),) for w in words], "word string").select(stem(F.col("word")).alias("term")).distinct()
        stems = [r.term for r in asked.collect()]
        held = keys(self.read().where(F.col("term").isin(stems)))
        return held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(stems)).select("key")
