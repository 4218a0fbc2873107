"""Date expressions. All built-in, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_diff(end: Column | str, start: Column | str) -> Column:
    """Whole calendar days from ``start`` to ``end`` (int; NULL if either is)."""
    return F.datediff(F.col(end) if isinstance(end, str) else end,
                      F.col(start) if isinstance(start, str) else start)


def month_index(ts: Column | str) -> Column:
    """Absolute month number ``year*12 + month - 1`` (int). Differences are
    calendar months; unlike ``months_between`` it is never fractional."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def month_label(m_idx: Column | str) -> Column:
    """``yyyy-MM`` text for a month index from :func:`month_index`."""
    c = F.col(m_idx) if isinstance(m_idx, str) else m_idx
    year = F.floor(c / 12).cast("int")
    month = (c - year * 12 + 1).cast("int")
    return F.format_string("%04d-%02d", year, month)


def add_days(ts: Column | str, days: Column | str) -> Column:
    """``ts`` plus a whole number of days, keeping the time of day and the
    timestamp flavour (``timestamp_ntz`` stays ``timestamp_ntz``)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    d = F.col(days) if isinstance(days, str) else days
    return F.timestamp_add("DAY", d, c)
