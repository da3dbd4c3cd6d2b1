"""Joins on ranges without an equal key, by cells of time.

An interval lives on the level whose cells are as long as it is, so it touches
two cells at most however long it is; there are no more levels than bits. A
point, or a shorter interval, is looked up in its cells of each level that any
interval lives on. Cells make an equal key, so Spark hashes or merges; no nested
loop is planned, and a long interval isn't copied into many cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The number of bits of an interval's length; cells of that level are longer than it."""
    return F.length(F.bin(F.greatest(end - start, F.lit(0)))).cast("int")


def _cell(value: Column, level: Column) -> Column:
    """floor(value / 2^level), for negative values too."""
    return F.call_function("shiftright", value, level)


def _levels(intervals: DataFrame) -> Column:
    """All levels that intervals live on, as a literal; there are 64 at most."""
    found = sorted(r[0] for r in intervals.select("_level").distinct().collect())
    return F.array(*[F.lit(k) for k in found]).cast("array<int>")


def _placed(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals with _start, _end and _level; those without a start or end, or that end before they start, are gone."""
    x = intervals.withColumns({"_start": start.cast("long"), "_end": end.cast("long")})
    return x.where("_start <= _end").withColumn("_level", _level(F.col("_start"), F.col("_end")))


def points_within(points: DataFrame, time: Column, intervals: DataFrame, start: Column, end: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Each point with each interval that holds it, both ends included: the columns of both, keys once.

    time, start and end are whole numbers (microseconds, days); keys are columns
    that both have and that have to be equal. A point or an interval with a null
    among these meets nothing. Other column names mustn't repeat.
    """
    own = _placed(intervals, start, end)
    cells = F.array_distinct(F.array(_cell(F.col("_start"), F.col("_level")), _cell(F.col("_end"), F.col("_level"))))
    own = own.withColumn("_cell", F.explode(cells))
    asked = points.withColumn("_time", time.cast("long")).where("_time is not null")
    asked = asked.withColumn("_level", F.explode(_levels(own))).withColumn("_cell", _cell(F.col("_time"), F.col("_level")))
    met = asked.join(own, [*keys, "_level", "_cell"]).where("_time between _start and _end")
    return met.drop("_time", "_start", "_end", "_level", "_cell")


def totals_within(points: DataFrame, time: Column, value: Column, intervals: DataFrame, name: str, start: Column, end: Column, cell_rows: int = 100_000) -> DataFrame:
    """name, n and total: the number of points in each interval, both ends included, and the sum of their values; only intervals with a point.

    No pair of a point and an interval is made: an interval's total is the total
    up to its end less the total before its start. Points and ends are dealt to
    cells of time of about cell_rows rows, totals run inside each cell, and the
    cells' own totals run over all cells. Intervals of one name add up. A null
    value is a point without a value.
    """
    own = _placed(intervals.select(F.col(name).alias("_name"), start.alias("_from"), end.alias("_to")), F.col("_from"), F.col("_to"))
    none = F.lit(0).cast("long")
    # at one moment a start comes before the points and an end after them
    marks = F.explode(F.array(F.struct(F.col("_start").alias("_time"), none.alias("_kind"), (none - 1).alias("_sign")), F.struct(F.col("_end").alias("_time"), (none + 2).alias("_kind"), (none + 1).alias("_sign"))))
    ends = own.select("_name", marks.alias("m")).select("_name", "m.*")
    met = points.select(time.cast("long").alias("_time"), value.alias("_value")).where("_time is not null")
    same = met.groupBy("_time").agg(F.count("*").alias("_n"), F.count("_value").alias("_known"), F.sum("_value").alias("_sum"))
    rows = same.withColumns({"_kind": none + 1, "_sign": none}).unionByName(ends, allowMissingColumns=True)
    size = rows.agg(F.min("_time"), F.max("_time"), F.count("*")).first()
    level = max(0, ((size[1] - size[0]) // (size[2] // cell_rows + 1)).bit_length()) if size[2] else 0
    rows = rows.withColumn("_cell", _cell(F.col("_time"), F.lit(level)))
    sums = ("_n", "_known", "_sum")
    cells = rows.groupBy("_cell").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row for each cell
    upto = Window.partitionBy("_cell").orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = cells.select("_cell", *[F.sum(c).over(before).alias(f"{c}_before") for c in sums])
    run = rows.select("_cell", "_name", "_sign", *[F.sum(c).over(upto).alias(c) for c in sums]).where("_sign <> 0").join(carried, "_cell")
    both = lambda c: F.sum(F.col("_sign") * (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"{c}_before"), F.lit(0))))
    totals = run.groupBy(F.col("_name").alias(name)).agg(both("_n").alias("n"), both("_known").alias("_known"), both("_sum").alias("total")).where("n > 0")
    return totals.select(name, "n", F.when(F.col("_known") > 0, F.col("total")).alias("total"))


def overlaps(intervals: DataFrame, name: str, start: Column, end: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals with a common moment, each once: keys, a and b (their names, a < b), first and last common moment.

    name is a column of distinct values. Each pair is reported in one cell, that
    of its first common moment on the longer one's level.
    """
    own = _placed(intervals, start, end).select(*keys, F.col(name).alias("_name"), "_start", "_end", "_level")
    two = lambda level: F.array_distinct(F.array(_cell(F.col("_start"), level), _cell(F.col("_end"), level)))
    long = own.withColumn("_cell", F.explode(two(F.col("_level")))).select(*keys, "_level", "_cell", *[F.col(c).alias(f"{c}_l") for c in ("_name", "_start", "_end")])
    short = own.withColumnRenamed("_level", "_own").withColumn("_level", F.explode(F.filter(_levels(own), lambda k: k >= F.col("_own"))))
    short = short.withColumn("_cell", F.explode(two(F.col("_level"))))
    first = F.greatest("_start", "_start_l")
    met = short.join(long, [*keys, "_level", "_cell"]).where((F.col("_start") <= F.col("_end_l")) & (F.col("_start_l") <= F.col("_end")) & (F.col("_cell") == _cell(first, F.col("_level"))))
    once = met.where((F.col("_own") < F.col("_level")) & (F.col("_name") != F.col("_name_l")) | (F.col("_own") == F.col("_level")) & (F.col("_name") < F.col("_name_l")))
    return once.select(*keys, F.least("_name", "_name_l").alias("a"), F.greatest("_name", "_name_l").alias("b"), first.alias("first"), F.least("_end", "_end_l").alias("last"))
