"""Small column helpers: NULL rules, exact rounding, date windows, ids."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def date_lit(as_of: datetime | date) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d")).cast("date")


def stamp(as_of: datetime) -> str:
    """Second-resolution run stamp used inside ids."""
    return as_of.strftime("%Y%m%d%H%M%S")


def days_after(as_of: datetime, n: int) -> Column:
    return F.date_add(date_lit(as_of), n)


def ts_plus_days(as_of: datetime, n: int) -> Column:
    return ts_lit(as_of) + F.make_dt_interval(F.lit(n))


def days_between(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from ``start`` to ``end``."""
    return F.datediff(end.cast("date"), start.cast("date"))


def strict_least(a: Column, b: Column) -> Column:
    """``least`` that is NULL as soon as one argument is; Spark's own skips NULLs."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clamp(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL, so that a default can be filled in afterwards."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round_exact(x: Column, digits: int) -> Column:
    """Half-up rounding through decimal, so that binary noise never decides a tie."""
    return F.round(x.cast("decimal(28,8)"), digits).cast("double")


def mean_exact(x: Column, digits: int) -> Column:
    """Average of values with ``digits`` decimals, summed as integers.

    Integer sums do not depend on row order, so a retried task or another partitioning cannot
    change the last bits of the result.
    """
    return F.sum(fixed_units(x, digits)).cast("double") / F.lit(float(10**digits)) / F.count(x)


def fixed_units(x: Column, digits: int) -> Column:
    """A value with ``digits`` decimals as a whole number of its last decimal."""
    return F.rint(x * float(10**digits)).cast("bigint")


def count_where(condition: Column) -> Column:
    """Sum of a 0/1 case: NULL, not 0, on empty input."""
    return F.sum(F.when(condition, 1).otherwise(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def live_until(expires_at: Column, as_of: datetime) -> Column:
    return expires_at.isNull() | (expires_at > ts_lit(as_of))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` + zero-padded number; numbers wider than ``width`` keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def pick(values, index: Column) -> Column:
    """0-based choice from a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def one_decimal(x: Column) -> Column:
    """Number as text with exactly one decimal, the same in every engine."""
    return F.round(x.cast("decimal(18,8)"), 1).cast("decimal(18,1)").cast("string")
