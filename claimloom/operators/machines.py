"""Small machines over the rows of a key in order of time, spread over blocks of time.

A machine has a few states; each row moves it on by a flag, and some moves make
it wait: rows that come within `wait` pass unmet, and the first one after meets
the state `wake`. Cooldowns and circuit breakers are such machines.

A key's rows are cut into blocks of time of at least `wait`, each a group of its
own, so that a key with all rows still spreads over tasks:

1. Each block computes its transfer map: the state (or the time waited for) it
   ends in, for each state at its first row, and for waking at each of the rows
   that an earlier wait can end at (those of the block's first `wait`, and one).
2. Maps are linked: a wait ends at the first later row at or after its time.
3. Which entries are reached from a key's first row is found by doubling the
   links: log2(blocks) rounds of joins on entries, not rows, each written.
4. Each block runs once more, from the entry that was reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written

UNMET = -1
_MAPS = "key string, block long, code long, time long, next int, until long"


@dataclass(frozen=True)
class Machine:
    """step[state][flag] is the next state, or UNMET for a wait of `wait` microseconds that ends in `wake`; `start` meets a key's first row."""

    step: tuple[tuple[int, int], ...]
    wait: int
    wake: int
    start: int = 0


def cooling(microseconds: int) -> Machine:
    """One state, in which each row is taken and followed by a wait."""
    return Machine(((UNMET, UNMET),), microseconds, 0)


def breaking(threshold: int, successes: int, microseconds: int) -> Machine:
    """States 0 to threshold - 1 are closed with so many failures in a row, the rest half open with so many successes."""
    closed = [(0, b + 1 if b + 1 < threshold else UNMET) for b in range(threshold)]
    half = [(threshold + g + 1 if g + 1 < successes else 0, UNMET) for g in range(successes)]
    return Machine((*closed, *half), microseconds, threshold)


def ends(machine: Machine, times: np.ndarray, flags: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each row and state that meets it: (last state, 0), or (UNMET, time waited for), behind the last row."""
    n = len(times)
    after = np.searchsorted(times, times + machine.wait).tolist()
    out: list[list[tuple[int, int]]] = [[]] * n
    behind = [(s, 0) for s in range(len(machine.step))]
    moves = [[row[f] for row in machine.step] for f in (0, 1)]
    for i in range(n - 1, -1, -1):
        onward = out[i + 1] if i + 1 < n else behind
        waiting = out[after[i]][machine.wake] if after[i] < n else (UNMET, int(times[i]) + machine.wait)
        out[i] = [waiting if s == UNMET else onward[s] for s in moves[int(flags[i])]]
    return out


def walk(machine: Machine, times: np.ndarray, flags: np.ndarray, first: int, state: int) -> np.ndarray:
    """The state that each row meets, UNMET before row `first` and during waits; `state` meets that row."""
    out = np.full(len(times), UNMET, np.int32)
    after = np.searchsorted(times, times + machine.wait).tolist()
    i, n, own = first, len(times), flags.tolist()
    while i < n:
        out[i] = state
        state = machine.step[state][own[i]]
        if state == UNMET:
            i, state = after[i], machine.wake
        else:
            i += 1
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, pa.Table]]:
    """Whole (key, block) groups of a sorted stream."""
    waiting: list[pa.RecordBatch] = []
    last = None

    def whole() -> Iterator[tuple[str | None, int, pa.Table]]:
        if waiting:
            yield *last, pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()

    for batch in batches:
        keys, blocks = batch.column("key").to_pylist(), batch.column("block").to_pylist()
        at = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or keys[k] != keys[at] or blocks[k] != blocks[at]:
                if last != (keys[at], blocks[at]):
                    yield from whole()
                    last = keys[at], blocks[at]
                waiting.append(batch.slice(at, k - at))
                at = k
    yield from whole()


def _maps(machine: Machine, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes below the number of states are states at the first row; the rest are rows to wake at, in order."""
    count = len(machine.step)
    for key, block, rows in _blocks(batches):
        times, flags = rows["time"].to_numpy(), rows["flag"].to_numpy()
        found = ends(machine, times, flags)
        wakes = min(len(times), int(np.searchsorted(times, block * width + machine.wait)) + 1)
        each = [(s, int(times[0]), *found[0][s]) for s in range(count)] + [(count + i, int(times[i]), *found[i][machine.wake]) for i in range(wakes)]
        code, time, state, until = zip(*each, strict=True)
        n = len(each)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(([key] * n, [block] * n, code, time, state, until), kinds, strict=True)], ["key", "block", "code", "time", "next", "until"])


def _met(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = len(machine.step)
    for _, _, rows in _blocks(batches):
        entry = rows["entry"][0].as_py()
        times, flags = rows["time"].to_numpy(), rows["flag"].to_numpy()
        if entry is None:
            met = np.full(len(times), UNMET, np.int32)
        else:
            met = walk(machine, times, flags, *((0, entry) if entry < count else (entry - count, machine.wake)))
        yield pa.record_batch([rows["key"].combine_chunks(), rows["time"].combine_chunks(), rows["flag"].combine_chunks(), rows["id"].combine_chunks(), pa.array(met)], ["key", "time", "flag", "id", "met"])


def _links(maps: DataFrame, width: int, count: int) -> DataFrame:
    """(key, block, code) to the entry that follows it, where one does."""
    blocks = maps.where("code = 0").select("key", "block", "time")
    blocks = blocks.withColumn("later", F.lead("block").over(Window.partitionBy("key").orderBy("block")))
    ends_in_state = maps.where(F.col("next") != UNMET).join(blocks.select("key", "block", "later"), ["key", "block"])
    one = ends_in_state.where("later is not null").select("key", "block", "code", F.col("later").alias("to_block"), F.col("next").cast("long").alias("to_code"))
    # A wait ends in the block of its time, at the first candidate at or after it, or else at the first row of the next block.
    waits = maps.where(F.col("next") == UNMET).select("key", "until").distinct().withColumn("block", F.floor(F.col("until") / width))
    rows = waits.select("key", "block", F.col("until").alias("time"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"))
    rows = rows.unionByName(maps.where(F.col("code") >= count).select("key", "block", "time", F.lit(1).alias("kind"), F.col("code").alias("at")))
    ahead = Window.partitionBy("key", "block").orderBy("time", "kind", "at").rowsBetween(0, Window.unboundedFollowing)
    found = rows.withColumn("to_code", F.first("at", ignorenulls=True).over(ahead)).where("kind = 0").select("key", F.col("time").alias("until"), "block", "to_code")
    inside = found.where("to_code is not null").select("key", "until", F.col("block").alias("to_block"), "to_code")
    beyond = found.where("to_code is null").select("key", "block", "until", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"))
    beyond = beyond.unionByName(blocks.select("key", "block", F.lit(None).cast("long").alias("until"), F.lit(-1).alias("kind"), F.col("block").alias("b")))
    onward = Window.partitionBy("key").orderBy("block", "kind").rowsBetween(1, Window.unboundedFollowing)
    beyond = beyond.withColumn("to_block", F.first("b", ignorenulls=True).over(onward)).where("kind = 0 and to_block is not null")
    targets = inside.unionByName(beyond.select("key", "until", "to_block", F.lit(count).cast("long").alias("to_code")))
    two = maps.where(F.col("next") == UNMET).join(targets, ["key", "until"]).select("key", "block", "code", "to_block", "to_code")
    return one.unionByName(two)


def run(rows: DataFrame, machine: Machine, key: Column, time: Column, flag: Column, row_id: Column, width: int | None = None) -> DataFrame:
    """key, time (microseconds), flag, id and met: the state that each row meets, UNMET (-1) while the machine waits.

    Rows go by time, then id. Rows without a time take no part, a null flag
    counts as false, null keys are one key. `width` is a block's length in
    microseconds, a day or 64 waits by default and no shorter than a wait; a
    task holds one block of one key at a time.
    """
    ship(rows.sparkSession)
    width = max(machine.wait, 1, width or max(64 * machine.wait, 86_400_000_000))
    count = len(machine.step)
    named = rows.select(key.cast("string").alias("key"), F.unix_micros(time.cast("timestamp")).alias("time"), F.coalesce(flag, F.lit(False)).cast("int").alias("flag"), row_id.cast("long").alias("id"))
    named = named.where("time is not null").withColumn("block", F.floor(F.col("time") / width)).withColumn("key", F.concat(F.when(F.col("key").isNull(), "-").otherwise("+"), F.coalesce("key", F.lit(""))))
    dealt = named.repartition("key", "block").sortWithinPartitions("key", "block", "time", "id")
    maps = written(dealt.mapInArrow(lambda b: _maps(machine, width, b), _MAPS), "machine-maps")
    first = Window.partitionBy("key")
    reached = maps.where(F.col("code") == machine.start).withColumn("least", F.min("block").over(first)).where("block = least").select("key", "block", "code")
    jump = written(_links(maps, width, count), "machine-links")
    reached, known = written(reached, "machine-reached"), 0
    while (now := reached.count()) > known:
        known = now
        onward = reached.join(jump, ["key", "block", "code"]).select("key", F.col("to_block").alias("block"), F.col("to_code").alias("code"))
        reached = written(reached.union(onward).distinct(), "machine-reached")
        far = jump.select("key", F.col("block").alias("to_block"), F.col("code").alias("to_code"), F.col("to_block").alias("b"), F.col("to_code").alias("c"))
        jump = written(jump.join(far, ["key", "to_block", "to_code"]).select("key", "block", "code", F.col("b").alias("to_block"), F.col("c").alias("to_code")), "machine-links")
    entries = reached.select("key", "block", F.col("code").alias("entry"))
    met = named.join(entries, ["key", "block"], "left").repartition("key", "block").sortWithinPartitions("key", "block", "time", "id")
    done = met.mapInArrow(lambda b: _met(machine, b), "key string, time long, flag int, id long, met int")
    return done.withColumn("key", F.when(F.left("key", F.lit(1)) == "+", F.substring("key", 2, 1 << 30)))
