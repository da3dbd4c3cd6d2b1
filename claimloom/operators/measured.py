"""Jobs that measure themselves: observed counters, gauges and timings of real runs, appended to the metric table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from datetime import datetime
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTS = "point_id long, name string, type string, ts timestamp_ntz, value decimal(18,2), labels map<string,string>"


class Recorder:
    """Collects the points of one run and appends them as one file; runs write files of their own, so several may run at once.

    as_of stands for the run's time, as nothing here reads the wall clock;
    timings come from a clock that only measures differences.
    """

    def __init__(self, spark: SparkSession, folder: str, as_of: datetime, **labels: str):
        self.spark, self.folder, self.as_of, self.labels = spark, folder, as_of, labels
        self.run, self._points, self._number = uuid.uuid4().hex, [], count(1)
        self._waiting: list[tuple[Observation, Mapping[str, str], dict[str, str]]] = []

    def point(self, name: str, kind: str, value: float, **labels: str) -> None:
        """A counter adds up, of a gauge the last value counts, a timer is one measurement."""
        self._points.append((name, kind, value, self.labels | labels))

    def observed(self, rows: DataFrame, name: str, counters: Mapping[str, Column] | None = None, gauges: Mapping[str, Column] | None = None, **labels: str) -> DataFrame:
        """The same rows; once an action has read them all, `name_rows` and the aggregates given are points of the run."""
        watch = Observation(f"{name}-{uuid.uuid4().hex}")
        kinds = {f"{name}_rows": "counter", **{f"{name}_{n}": "counter" for n in counters or {}}, **{f"{name}_{n}": "gauge" for n in gauges or {}}}
        aggregates = [F.count(F.lit(1)), *(counters or {}).values(), *(gauges or {}).values()]
        self._waiting.append((watch, kinds, labels))
        return rows.observe(watch, *[c.alias(n) for n, c in zip(kinds, aggregates, strict=True)])

    @contextmanager
    def timed(self, name: str, **labels: str) -> Iterator[None]:
        """Seconds that the block takes, as a timer; and a counter of its failures."""
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.point(f"{name}_failed", "counter", 1, **labels)
            raise
        finally:
            self.point(f"{name}_seconds", "timer", time.perf_counter() - began, **labels)

    def save(self) -> DataFrame:
        """Appends the points; what was observed is waited for, so the actions have to be done. Returns the points of all runs."""
        for watch, kinds, labels in self._waiting:
            for n, value in watch.get.items():
                self.point(n, kinds[n], 0 if value is None else value, **labels)
        self._waiting = []
        if self._points:
            rows = [(next(self._number), n, kind, self.as_of, f"{value:.2f}", labels) for n, kind, value, labels in self._points]
            made = self.spark.createDataFrame(rows, POINTS.replace("decimal(18,2)", "string"))
            made.withColumn("value", F.col("value").cast("decimal(18,2)")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/run={self.run}")
            self._points = []
        return self.spark.read.schema(POINTS + ", run string").parquet(self.folder)


def measured(recorder: Recorder, name: str, rows: DataFrame, act: Callable[[DataFrame], object], **aggregates: Column) -> DataFrame:
    """Runs an action over rows, observed and timed, and returns the metric table."""
    with recorder.timed(name):
        act(recorder.observed(rows, name, aggregates))
    return recorder.save()
