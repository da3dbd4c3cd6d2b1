"""Tables of a database: read in ranges of about equal size, written in batches, upserted once whatever is retried.

    db = Database("jdbc:derby:/data/claims", driver="org.apache.derby.jdbc.EmbeddedDriver")
    db.read(spark, "claims", key="claim_key", partitions=64).where("total_charge > 100")

Filters and columns go to the database. The driver's jar is the user's to
supply, but for Derby, which Spark carries. (To Derby Spark writes null strings
as CLOB, which its VARCHAR columns refuse; its CLOB columns take them.)
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import accumulate, pairwise
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 16  # ranges for each partition, of which the counts are asked
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def _named(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no plain name")
    return name


def bounds(counts: Sequence[tuple[int, int]], partitions: int) -> list[int]:
    """Where to cut bins of (number, rows), so that the parts have about equal rows: the first bins of all parts but the first."""
    total = sum(n for _, n in counts)
    cuts, part = [], 1
    for (number, n), seen in zip(counts, accumulate(n for _, n in counts), strict=True):
        if seen - n >= part * total / partitions:
            cuts.append(number)
            part = int((seen - n) * partitions / total) + 1
    return cuts


@dataclass(frozen=True)
class Database:
    """url is written to and read; with a replica, reads that may be a little old go there (read_only)."""

    url: str
    driver: str | None = None
    replica: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    fetch: int = 10_000
    quote: str = '"'  # around column names, as Spark writes them for this database

    def _column(self, name: str) -> str:
        return f"{self.quote}{_named(name)}{self.quote}"

    def _reader(self, spark: SparkSession, read_only: bool):
        url = self.replica if read_only and self.replica else self.url
        own = {"driver": self.driver} if self.driver else {}
        return spark.read.format("jdbc").options(url=url, fetchsize=str(self.fetch), **own, **self.options)

    def read(self, spark: SparkSession, table: str, key: str | None = None, partitions: int = 32, read_only: bool = True) -> DataFrame:
        """A table, in one task, or in ranges of a whole-number key with about equal rows each.

        The database counts the rows of BINS * partitions equal ranges of the key,
        again within each that has more rows than a part should, and neighbours
        are joined up to equal parts. So the driver sees some thousand counts,
        however large the table or uneven its keys. Rows of one key value stay
        together: take a key with many values. Rows without a key are a part.
        Rows that come after the ranges were counted are read by the outer ones.
        """
        conditions = self.ranges(spark, table, key, partitions, read_only) if key is not None else ["1 = 1"]
        url = self.replica if read_only and self.replica else self.url
        own = {"driver": self.driver} if self.driver else {}
        return spark.read.jdbc(url, _named(table), predicates=conditions, properties={"fetchsize": str(self.fetch), **own, **self.options})

    def ranges(self, spark: SparkSession, table: str, key: str, partitions: int, read_only: bool = True) -> list[str]:
        """Conditions in SQL, of which each row of the table meets one."""
        table, key = _named(table), self._column(key)
        ask = lambda text: self._reader(spark, read_only).option("query", text).load()
        low, high = ask(f"SELECT min({key}) AS low, max({key}) AS high FROM {table}").first()
        if low is None or partitions < 2:
            return ["1 = 1"]
        total = int(ask(f"SELECT count(*) AS n FROM {table} WHERE {key} IS NOT NULL").first()[0])
        bins, open_ranges = [], [(int(low), int(high))]
        while open_ranges:
            low, high = open_ranges.pop()
            width = (high - low) // (partitions * BINS) + 1
            binned = f"SELECT ({key} - ({low})) / {width} AS bin_number FROM {table} WHERE {key} BETWEEN {low} AND {high}"
            for number, n in ask(f"SELECT bin_number, count(*) AS n FROM ({binned}) binned GROUP BY bin_number").collect():
                start = low + int(number) * width
                if n * partitions > total and width > 1:
                    open_ranges.append((start, min(start + width - 1, high)))
                else:
                    bins.append((start, int(n)))
        cuts = bounds(sorted(bins), partitions)
        if not cuts:
            return ["1 = 1"]
        inner = [f"{key} >= {a} AND {key} < {b}" for a, b in pairwise(cuts)]
        return [f"{key} < {cuts[0]} OR {key} IS NULL", *inner, f"{key} >= {cuts[-1]}"]

    def write(self, rows: DataFrame, table: str, mode: str = "append", types: Mapping[str, str] | None = None, partitions: int = 8, batch: int = 5_000) -> None:
        """Rows in batches, over at most `partitions` connections. mode overwrite empties a table and keeps its definition.

        Each task is one transaction, yet a task that is lost after its commit
        is run again and its rows come twice: use insert_absent where that counts.
        """
        known = {"createTableColumnTypes": ", ".join(f"{c} {kind}" for c, kind in types.items())} if types else {}
        own = {"driver": self.driver} if self.driver else {}
        options = {"url": self.url, "dbtable": _named(table), "batchsize": str(batch), "truncate": "true", **known, **own, **self.options}
        rows.coalesce(partitions).write.format("jdbc").mode(mode).options(**options).save()

    def insert_absent(self, rows: DataFrame, table: str, key: str, types: Mapping[str, str], partitions: int = 8) -> int:
        """Inserts rows whose key the table lacks, one for each key (which of them isn't said), and returns how many; rows without a key stay out.

        Rows go to a table beside it first. One statement then moves the new
        ones: whatever tasks were run twice, and however often this is called
        with the same rows, each key comes once. types names the columns' types
        in the database; they have to be comparable there.
        """
        name, columns = self._column(key), [self._column(c) for c in rows.columns]
        beside, listed = f"{_named(table)}_{uuid4().hex[:12]}", ", ".join(columns)
        self.write(rows.where(F.col(key).isNotNull()).dropDuplicates([key]), beside, types=types, partitions=partitions)
        try:
            with self._statement(rows.sparkSession) as run:
                # a task that ran twice may have chosen another row of the key: one of them by the smallest values
                one = ", ".join(c if c == name else f"min({c}) AS {c}" for c in columns)
                fresh = f"SELECT {one} FROM {beside} GROUP BY {name}"
                return run(f"INSERT INTO {table} ({listed}) SELECT {listed} FROM ({fresh}) fresh WHERE NOT EXISTS (SELECT 1 FROM {table} known WHERE known.{name} = fresh.{name})")
        finally:
            with self._statement(rows.sparkSession) as run:
                run(f"DROP TABLE {beside}")

    @contextmanager
    def _statement(self, spark: SparkSession):
        """Runs statements on one connection of the driver, as Spark only reads and writes whole tables; all or none of them count."""
        jvm = spark.sparkContext._jvm
        if self.driver:
            jvm.java.lang.Class.forName(self.driver)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, self.options.get("user"), self.options.get("password")) if "user" in self.options else jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            connection.setAutoCommit(False)
            yield lambda text: connection.createStatement().executeUpdate(text)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()
