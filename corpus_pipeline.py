"""A training corpus from raw documents, in stages.

Each stage takes what its predecessor kept and all but the last return the
columns of documents: toxic documents go, one document of each class of near
copies stays, secrets are masked, sources are mixed to their targets (documents
are repeated, or dropped, as the mix takes them) and the texts are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import toxicity
from claimloom.llm.common import SPACES, broadcast_if_small, checkpointed, column, ship, table, written
from claimloom.llm.mixing import mix_sources, with_sizes
from claimloom.llm.ngram_join import ngram_jaccard_classes
from claimloom.llm.pieces import encode_pieces
from claimloom.llm.secrets import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_SPACE = "[" + "".join(f"\\x{b:02X}" for b in SPACES) + "]"
_NOT_SPACE = "[^" + _SPACE[1:]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest id (null last), then the first in the files.

    Rows are told apart by their place in the files that `docs` is read from (a
    frame without files is checkpointed first), so rows without an id and rows
    that repeat an id are judged by their texts too.
    """
    ship(spark)
    if not docs.inputFiles():
        docs = checkpointed(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*[column(c).alias(c) for c in docs.columns]).alias("row"))
    classes = ngram_jaccard_classes(rows.select("at", "row.text"), percent=75, width=5, id_col="at").select(F.col("doc_id").alias("at"), "component_id")
    place = F.struct(F.col("row.doc_id").isNull().alias("a"), F.col("row.doc_id").alias("b"), F.col("at").alias("c"))
    judged = checkpointed(rows.select("at", place.alias("place")).join(classes, "at"))
    stay = judged.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.c").alias("at"))
    go = checkpointed(judged.select("at").join(stay, "at", "left_anti"))
    return rows.join(broadcast_if_small(go), "at", "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their owner-specific secrets masked."""
    ship(spark)
    return redact_secrets(docs, repo_col="doc_id", owner_col="source", shared_owners=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; a last part is a document's first words."""
    mixed = mix_sources(with_sizes(docs, carry=True), weights=(1, 2, 3), most=3)
    words = F.split(F.regexp_replace(F.col("row.text"), f"^{_SPACE}+", ""), f"(?<={_SPACE})(?={_NOT_SPACE})")
    part = F.array_join(F.slice(words, 1, F.col("part").cast("int")), "")
    passes = F.arrays_zip(F.col("due"), F.sequence(F.lit(1), F.greatest(F.col("passes"), F.lit(1))).alias("number"))
    each = mixed.where("passes > 0").withColumn("pass", F.explode(passes))
    text = F.when(F.col("pass.number") > F.col("whole"), part).otherwise(F.col("row.text"))
    columns = [(text if c == "text" else F.char_length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns]
    placed = each.select(F.col("pass.due").alias("due"), F.struct(*columns).alias("row"))
    return placed.orderBy("due", "row.doc_id").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and their number; round_trip says whether they decode to the text."""
    ship(spark)
    return encode_pieces(docs).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Trained scores, near copies and byte-pair encoding have no SQL form; tests hold run() against plain Python, stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents one after another; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
