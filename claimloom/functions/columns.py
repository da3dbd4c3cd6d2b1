"""Scalar functions as Column expressions: dates, money, masks, hashes, arrays, JSON."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def at(moment: datetime) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def since(column: str | Column, moment: datetime, amount: int, unit: str) -> Column:
    """Whether a time lies within the last `amount` units before a moment (the start included)."""
    column = F.col(column) if isinstance(column, str) else column
    return column >= at(moment) - F.expr(f"INTERVAL {amount} {unit}")


def truncated(unit: str, column: str | Column) -> Column:
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def boundaries(unit: str, a: Column, b: Column) -> Column:
    """How many starts of a unit lie between two times, as DATEDIFF counts them."""
    return F.timestamp_diff(unit, F.date_trunc(unit, a), F.date_trunc(unit, b))


def money(cents: Column, kind: str = MONEY) -> Column:
    """Whole cents as a decimal amount."""
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(kind)


def total(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column).cast(MONEY)


def mean(column: str | Column) -> Column:
    """The mean of exact decimals, the same in every engine: exact sum over count, as a double."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column).cast("double") / F.count(column)


def percent(part: Column, whole: Column) -> Column:
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), 6)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def blank(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | (F.regexp_replace(column, r"\s", "") == "")


def json_text(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def mask(column: str | Column, kind: str = "generic") -> Column:
    """Hides personal data: ssn, dob_year, name, account_number, or anything else. Null and empty stay."""
    c = F.col(column) if isinstance(column, str) else column
    plain = F.when(F.length(c) > 3, F.repeat(F.lit("*"), F.length(c))).otherwise(c)
    tail = F.right(c, F.lit(4))
    if kind == "ssn":
        hidden = F.when(F.length(c) >= 9, F.concat(F.lit("***-**-"), tail)).otherwise(plain)
    elif kind == "dob_year":
        parts = F.split(c, "-", -1)
        hidden = F.when(F.size(parts) == 3, F.concat(parts[0], F.lit("-XX-XX"))).otherwise(F.lit("XXXX-XX-XX"))
    elif kind == "name":
        hidden = F.concat(F.left(c, F.lit(1)), F.lit("***"), F.when(F.length(c) > 1, F.right(c, F.lit(1))).otherwise(F.lit("*")))
    elif kind == "account_number":
        hidden = F.when(F.length(c) > 4, F.concat(F.lit("********"), tail)).otherwise(plain)
    else:
        hidden = plain
    return F.when(F.length(c) > 0, hidden).otherwise(c)


def wrapped(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("encrypted("), F.reverse(c), F.lit(")"))


def unwrapped(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.startswith("encrypted(") & c.endswith(")"), F.reverse(F.substring(c, 11, F.length(c) - 11))).otherwise(c)


def salted_hash(column: str | Column, salt: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(c) > 0, F.sha2(F.concat(F.lit(salt), c), 256))


def feature_key(*columns: str) -> Column:
    """A short digest of features, for result caches."""
    return F.left(F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in columns])), F.lit(8))


def joined(parts: Column, separator: str = ", ", empty: str = "N/A") -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, separator)).otherwise(F.lit(empty))


def label_key(name: Column, labels: Column) -> Column:
    """name{k=v,...} with sorted keys; the bare name without labels."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), pairs, F.lit("}"))).otherwise(name)


def search_tokens(columns: Sequence[str], stop: Sequence[str] = ("a", "an", "and", "of", "or", "the", "to")) -> Column:
    text = F.lower(F.concat_ws(" ", *columns))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*stop))))


def batch_size(rows: Column, memory_mb: Column, seconds: Column) -> Column:
    """Rows of a batch: within memory at 1 KB a row, time at 100 rows a second, a hundredth of all, and 100..10,000."""
    share = F.greatest((rows / 100).cast("bigint"), F.lit(100))
    return F.greatest(F.least((memory_mb * 1024).cast("bigint"), (seconds * 100).cast("bigint"), share, F.lit(10_000)), F.lit(100)).cast("bigint")


def retry_delay(first: float, factor: float, attempt: Column) -> Column:
    return F.lit(first) * F.pow(F.lit(factor), attempt)
