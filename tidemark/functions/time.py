"""Calendar parts of epoch milliseconds, in UTC whatever the session zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MS = 86_400_000


def epoch_date(ts_ms: Column | str) -> Column:
    c = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / F.lit(_DAY_MS)).cast("int"))


def epoch_year(ts_ms: Column | str) -> Column:
    return F.year(epoch_date(ts_ms))


def epoch_month(ts_ms: Column | str) -> Column:
    return F.month(epoch_date(ts_ms))


def in_years(ts_ms: Column | str, first: int, last: int) -> Column:
    """Year range test on the raw milliseconds, so that it reaches the Parquet scan as a range filter."""
    from datetime import date

    c = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    origin = date(1970, 1, 1)
    lo = (date(first, 1, 1) - origin).days * _DAY_MS
    hi = (date(last + 1, 1, 1) - origin).days * _DAY_MS
    return (c >= F.lit(lo)) & (c < F.lit(hi))
