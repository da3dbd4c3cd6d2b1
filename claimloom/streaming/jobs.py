"""Structured Streaming versions: each runs to the end of its input and leaves a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.columns import money
from ..operators import monitoring, validation
from ..params import Params
from ..session import ship
from ..sources.testdata import Tables

OUT_ROWS = 50_000  # of a key that go back to Spark at once


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint directory; under /tmp/checkpoints with a local master where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return f"{shared or 'file:///tmp/checkpoints'}/stream-{uuid.uuid4().hex}"


def stream_of(t: Tables, name: str, files: int = 64) -> DataFrame:
    """A table's files as a stream, at most `files` of them in a batch. A single file is read through its parent folder by name."""
    spark, schema = t.spark, t.read(name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{t.path}/{name}.parquet*")


def finished(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote.

    Without keys rows are appended to parquet by the file sink (exactly once).
    With keys the stream's results are updated: each batch writes the rows that
    it changed into a folder of its own (a batch that runs again overwrites
    itself), and of each key the latest batch's row is read. State leaves with
    the watermark, since no batch needs the rows of earlier ones.
    """
    spark, base = stream.sparkSession, work_folder(stream.sparkSession)
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if keys is None:
        writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    writer.outputMode("update").foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{base}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("row")).select("row.*")


def _timed(t: Tables) -> DataFrame:
    return stream_of(t, "events").withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(t: Tables, size: str = "1 hour") -> DataFrame:
    counts = _timed(t).withWatermark("at", "1 day").groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return finished(counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"), ["window_start", "event_type"])


def sliding(t: Tables, size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    counts = _timed(t).withWatermark("at", "1 day").groupBy(F.window("at", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return finished(counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"), ["window_start", "event_type"])


def deduplicated(t: Tables) -> DataFrame:
    """Events once each, though the stream carries all of them twice."""
    twice = _timed(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return finished(twice.withWatermark("at", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"))


def counted(t: Tables) -> DataFrame:
    """Running counts by type, updated batch by batch."""
    counts = stream_of(t, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return finished(counts, ["event_type"])


def breaker_stream(t: Tables, keep_ms: int = 30 * 24 * 3_600_000) -> DataFrame:
    """The circuit breaker over points as they arrive, in state kept for each key; files must arrive in order of time.

    A key that is silent for keep_ms of event time (beyond the watermark) is forgotten.
    """
    ship(t.spark)

    def follow(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [tuple(rows_[c].to_numpy() for c in ("t", "failed", "point_id")) for rows_ in rows]
        t, failed, points = (np.concatenate([p[i] for p in parts]) for i in range(3))  # one key's rows of one batch, 17 bytes each
        del parts
        order = np.lexsort((points, t))
        t, failed, points = t[order], failed[order], points[order]
        now = tuple(state.get) if state.exists else monitoring.CLOSED
        last = int(1000 * np.nanmax(t))
        for start in range(0, len(t), OUT_ROWS):
            met = []
            for moment, bad in zip(t[start : start + OUT_ROWS].tolist(), failed[start : start + OUT_ROWS].tolist(), strict=True):
                seen, now = monitoring.breaker_step(now, moment, bad)
                met.append(seen)
            yield pd.DataFrame({"key": key[0], "point_id": points[start : start + OUT_ROWS], "state": met})
        state.update(now)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)

    value = money(F.round(F.col("value") * 100).cast("bigint"), "decimal(12,2)")
    calls = _timed(t).withWatermark("at", "1 day").select("at", F.col("event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), (value > 12).alias("failed"), F.col("event_id").alias("point_id"))
    kept = "kind string, bad int, good int, opened double"
    return finished(calls.groupBy("key").applyInPandasWithState(follow, "key string, point_id long, state string", kept, "append", GroupStateTimeout.EventTimeTimeout))


def pipeline(t: Tables, p: Params) -> DataFrame:
    """Claims validated as they arrive, valid and failed ones written apart by batch number, then summed.

    Orders are the stream, customers and departments its static sides, so each
    batch is the same plan as the batch job's.
    """
    spark, base = t.spark, work_folder(t.spark)

    def process(batch: DataFrame, number: int) -> None:
        own = Tables(spark, t.path)
        whole = own.read
        own.read = lambda name: batch if name == "orders" else whole(name)  # the batch takes the table's place
        done = validation.validate(own, own.claims, p).select("claim_id", "facility_id", "is_valid").persist()
        done.where("is_valid").write.mode("overwrite").parquet(f"{base}/valid/batch={number}")
        done.where("not is_valid").write.mode("overwrite").parquet(f"{base}/failed/batch={number}")
        done.unpersist()

    stream = stream_of(t, "orders")
    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(process).start().awaitTermination()
    schema = "claim_id string, facility_id string, is_valid boolean, batch long"
    both = spark.read.schema(schema).parquet(f"{base}/valid").unionByName(spark.read.schema(schema).parquet(f"{base}/failed"))
    return both.groupBy("facility_id").agg(F.count("*").alias("claims"), F.count_if("is_valid").alias("valid_claims"))
