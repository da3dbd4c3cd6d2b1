"""Keyed stream state: timers that fire, keys that expire, late rows that are counted, state read back."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from claimloom.streaming import signals

START = datetime(2024, 1, 1)
ROWS = "key string, at timestamp, id long, failed boolean, value double"


def test_four_batches_with_a_timer_an_expired_key_and_late_rows(spark, tmp_path):
    """Key q is silent after the first file; two rows of the last file lie days behind the watermark."""
    files = []
    for f in range(4):
        own = [(k, START + timedelta(days=2 * f, minutes=20 * n), 100 * f + 10 * i + n, n % 3 != 0, float(n)) for i, k in enumerate(["a", "b"] + ["q"] * (f == 0)) for n in range(8)]
        files.append(own + ([("a", START, 900, True, 1.0), ("q", START + timedelta(days=1), 901, True, 1.0)] if f == 3 else []))
        spark.createDataFrame(files[-1], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(0.05)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    done = signals.run(stream, cooldown_seconds=3600, alpha=0.5, keep_ms=3 * 24 * 3_600_000, delay="1 hour")
    rows = done.rows.collect()
    assert done.batches == 4 and done.late_rows == 2
    assert [(r.key, r.id) for r in rows if r.note == "expired"] == [("q", -1)]

    want, state = set(), {}
    for k, at, i, failed, value in sorted((r for f in files for r in f if r[2] < 900), key=lambda r: (r[1], r[2])):
        last, average, streak = state.get(k, (None, None, 0))
        go = last is None or (at - last).total_seconds() >= 3600
        state[k] = at if go else last, value if average is None else 0.5 * average + 0.5 * value, streak + 1 if failed else 0
        want.add((k, i, go, state[k][1], state[k][2]))
    assert {(r.key, r.id, r.sent, r.average, r.streak) for r in rows if r.note == "row"} == want

    kept = {r.key.key: r.value for r in done.state("signal").collect()}
    assert {k: v.average for k, v in kept.items()} == {k: state[k][1] for k in ("a", "b")}  # q has been forgotten
    assert {r.key.key: r.user_map_value.n for r in done.state("outcomes").collect() if r.user_map_key.failed} == {k: state[k][2] for k in ("a", "b")}


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/in")
    done = signals.run(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"))
    assert done.rows.count() == 0 and done.late_rows == 0
