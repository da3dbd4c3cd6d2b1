"""Cooldown, moving average and failure streak of each key, kept in stream state with event-time timers."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..sources.testdata import Tables
from .jobs import work_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id long, note string, sent boolean, average double, streak long"
_NEVER = -(1 << 62)


class Signals(StatefulProcessor):
    """Rows (key, at, micros, id, failed, value) in; each row back with note 'row', whether it is sent, the average and the streak.

    Value state holds the last sent time and the average, map state the rows of
    either outcome since the last change (the streak is that of failures). A
    timer of event time is set at the key's last row plus keep_ms; when the
    watermark passes it, the key is forgotten and a row with note 'expired' comes out.
    """

    def __init__(self, cooldown_seconds: int, alpha: float, keep_ms: int) -> None:
        self.pause, self.alpha, self.keep_ms = cooldown_seconds * 1_000_000, alpha, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signal = handle.getValueState("signal", "sent long, average double")
        self.outcomes = handle.getMapState("outcomes", "failed boolean", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "id"], kind="stable")  # one key's rows of one batch
        last, average = self.signal.get() if self.signal.exists() else (_NEVER, None)
        streak = self.outcomes.getValue((True,))[0] if self.outcomes.containsKey((True,)) else 0
        sent, averages, streaks = [], [], []
        for moment, failed, value in zip(batch["micros"].tolist(), batch["failed"].tolist(), batch["value"].tolist(), strict=True):
            go = moment - last >= self.pause
            last = moment if go else last
            average = value if average is None else average * (1 - self.alpha) + value * self.alpha
            streak = streak + 1 if failed else 0
            sent.append(go)
            averages.append(average)
            streaks.append(streak)
        self.signal.update((last, average))
        self.outcomes.updateValue((True,), (streak,))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(int(batch["micros"].iloc[-1]) // 1000 + self.keep_ms)
        yield pd.DataFrame({"key": key[0], "id": batch["id"], "note": "row", "sent": sent, "average": averages, "streak": streaks})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.signal.clear()
        self.outcomes.clear()
        yield pd.DataFrame({"key": [key[0]], "id": [-1], "note": ["expired"], "sent": [False], "average": [0.0], "streak": [0]})

    def close(self) -> None:
        pass


class _Late(StreamingQueryListener):
    """Rows that came behind the watermark, and batches, of one query, from its progress."""

    def __init__(self) -> None:
        self.rows, self.batches, self.done, self.id = 0, 0, threading.Event(), None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.id in (None, str(event.progress.id)):
            self.rows += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
            self.batches += event.progress.numInputRows > 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.id in (None, str(event.id)):
            self.done.set()


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and named state need, for the streams that start inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


@dataclass
class Finished:
    rows: DataFrame
    late_rows: int  # rows behind the watermark: counted here, absent from rows
    batches: int
    checkpoint: str

    def state(self, name: str) -> DataFrame:
        """A state variable as it was left: key, value."""
        return self.rows.sparkSession.read.format("statestore").option("stateVarName", name).load(self.checkpoint)


def run(stream: DataFrame, cooldown_seconds: int = 3600, alpha: float = 0.1, keep_ms: int = 30 * 24 * 3_600_000, delay: str = "1 day") -> Finished:
    """Signals over a stream with key, at (timestamp), id, failed and value, to the end of what is there.

    Files have to arrive in order of time; `delay` is how far a row may stay
    behind. A key that is silent for keep_ms of event time is forgotten.
    """
    spark, base = stream.sparkSession, work_folder(stream.sparkSession)
    ship(spark)
    rows = stream.select(F.col("key").cast("string").alias("key"), "at", F.unix_micros("at").alias("micros"), F.col("id").cast("long").alias("id"), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("value").cast("double").alias("value"))
    kept = rows.where("at is not null and value is not null").withWatermark("at", delay)
    late = _Late()
    with _store(spark):
        spark.streams.addListener(late)
        signals = kept.groupBy("key").transformWithStateInPandas(Signals(cooldown_seconds, alpha, keep_ms), OUT, "Append", "EventTime")
        query = signals.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/rows").start()
        late.id = query.id
        query.awaitTermination()
        late.done.wait(30)
        spark.streams.removeListener(late)
    return Finished(spark.read.schema(OUT).parquet(f"{base}/rows"), late.rows, late.batches, f"{base}/state")


def in_files(rows: DataFrame, time: str, files: int) -> str:
    """Rows as `files` sets of files in order of time, one after another, in the shared folder; for streams that read one at a time."""
    folder = f"{work_folder(rows.sparkSession)}/arriving"
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    part = F.least(F.floor((F.unix_micros(time) - F.lit(first or 0)) * files / F.lit((last or 0) - (first or 0) + 1)), F.lit(files - 1))
    for k in range(files):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def signal_stream(t: Tables, files: int = 4) -> DataFrame:
    """Events as they arrive in four files, a file a batch: key, point_id, sent, average and streak of every event."""
    points = t.metric_points.select(F.col("name").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("point_id").alias("id"), (F.col("value") > 12).alias("failed"), F.col("value").cast("double").alias("value"))
    folder = in_files(points, "at", files)
    stream = t.spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    done = run(stream, delay="1 hour", keep_ms=365 * 24 * 3_600_000)
    return done.rows.where("note = 'row'").select("key", F.col("id").alias("point_id"), "sent", F.round("average", 6).alias("average"), "streak")
