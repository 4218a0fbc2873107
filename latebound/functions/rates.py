"""Zero-safe ratios and exact money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as DOUBLE; NULL when ``den`` is 0 or NULL (never raises
    under ANSI mode, never yields infinity)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def money_sum(col: Column | str) -> Column:
    """Exact decimal sum (order independent, so every engine and every
    partitioning gives the same digits)."""
    return F.sum(_c(col))


def money_out(col: Column | str) -> Column:
    """Decimal money cast to DOUBLE for output, after all arithmetic."""
    return _c(col).cast("double")


def count_true(cond: Column) -> Column:
    """Number of rows where ``cond`` holds (bigint)."""
    return F.count(F.when(cond, F.lit(1)))


def int_sum(col: Column | str) -> Column:
    """Sum of an integer column as bigint (0 rows -> NULL, like SQL)."""
    return F.sum(_c(col)).cast("long")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's coefficient of the rows that have both; NULL where one of them does not vary
    (``F.corr`` divides by zero there)."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
