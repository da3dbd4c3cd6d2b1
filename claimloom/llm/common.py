"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What splits words in the contracts: \x20 and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each context, wherever they run.

    Long texts make large Arrow batches, so a batch's default of 10,000 rows is lowered.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if getattr(context, "_claimloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._claimloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table through Spark's own reader, so any Hadoop path works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: spark.checkpoint.dir of the session, or the context's if that is set.

    Where neither is set a local master (tests, one machine) gets a folder under
    /tmp/checkpoints and a cluster an error, since no other folder is known to be shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(shared or f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table of Parquet into the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the folder that the cluster shares.

    A collection follows, so that Spark's cleaner drops the shuffle files that the
    cut lineage no longer needs.
    """
    shared_folder(df.sparkSession)
    cut = df.checkpoint(eager=True)
    del df
    gc.collect()
    cut.sparkSession.sparkContext._jvm.System.gc()
    return cut


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A hint to broadcast a narrow table whose rows are counted to be few; beyond that Spark's own join stands."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


Batches = Iterator[pa.RecordBatch]


#: How to forget what a module remembers between the tasks of a worker.
REMEMBERED: dict[str, Callable[[], object]] = {}


def _release(module: str) -> None:
    """Forgets what modules other than this one remember and gives free memory back, since Spark keeps idle workers for the next stage."""
    for name, forget in REMEMBERED.items():
        if name != module:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[..., Batches], *settings: object) -> Callable[[Batches], Batches]:
    """run(*settings, batches) for mapInArrow.

    Its memory is given back when a task ends, and what other operators left in
    the worker when one begins; only what its own module remembers stays.
    """

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        _release(run.__module__)
        try:
            yield from run(*settings, batches)
        finally:
            _release(run.__module__)

    return whole


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def join_hot(rows: DataFrame, facts: DataFrame, key: str, salt: str, most: int = 1000) -> DataFrame:
    """Rows with the facts of their key; facts has one row for each key and counts its rows in the column `rows`.

    Keys with a `most`-th of all rows or more (there are no more than `most`) are
    broadcast and their rows stay where they are, so that no hot key lands in one
    task; the other rows meet their facts by shuffle. Every row has its facts.
    """
    facts = checkpointed(facts)
    total = facts.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * most >= total
    names = [c for c in facts.columns if c not in (key, "rows")]
    hot = facts.where(is_hot).select(F.col(key), F.struct(*names).alias("_hot"))
    cold = facts.where(~is_hot).select(F.col(key).alias("_key"), F.struct(*names).alias("_cold"))
    met = rows.join(F.broadcast(hot), key, "left")
    # A row that has met its facts gets a key of its own that no other row looks for.
    away = F.concat(F.lit("!"), F.col(salt).cast("string"))
    met = met.withColumn("_side", F.when(F.col("_hot").isNull(), F.concat(F.lit("="), F.col(key).cast("string"))).otherwise(away))
    cold = cold.withColumn("_side", F.concat(F.lit("="), F.col("_key").cast("string"))).drop("_key")
    found = F.coalesce("_hot", "_cold")
    return met.join(cold, "_side", "left").select(*rows.columns, *[found[n].alias(n) for n in names])


def spread(column: Column, salt: str) -> Column:
    """A reproducible pseudo-random long for each value, nulls included."""
    return F.xxhash64(F.lit(salt), column)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if column.null_count:  # a null may still have bytes behind it
        keep = np.asarray(column.is_valid())
        sizes = np.diff(offsets)
        if (sizes[~keep] > 0).any():
            raw = raw[np.repeat(keep, sizes)]
            sizes = np.where(keep, sizes, 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return raw, offsets


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together (one longer row stands alone)."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def crc(value: object) -> int:
    return zlib.crc32(str(value).encode())


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; the folder is a parameter, /opt/tokenizers by default."""
    return os.path.join(folder or "/opt/tokenizers", name)
