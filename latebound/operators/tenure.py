"""A7: delay by seller tenure; A13: the long-tenure, low-delay badge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import money_out, ratio


def tenure_bucket(tenure: Column, long_months: int = 13) -> Column:
    """``<long>+`` calendar months, below it ``1`` (one-off), ``2-6`` and ``7-<long-1>``."""
    middle = min(6, long_months - 1)
    return (F.when(tenure >= long_months, F.lit(f"{long_months}+"))
            .when(tenure <= 1, F.lit("1"))
            .when(tenure <= middle, F.lit(f"2-{middle}"))
            .otherwise(F.lit(f"7-{long_months - 1}")))


def _tenure(basis: str) -> Column:
    """``span``: calendar months from first to last sale; ``active``: months
    with a sale."""
    if basis not in ("span", "active"):
        raise ValueError(f"tenure basis must be span or active, not {basis!r}")
    return F.col("tenure") if basis == "span" else F.col("active_months")


def tenure_vs_delay(profile: DataFrame, long_months: int = 13, basis: str = "span") -> DataFrame:
    """``bucket, sellers, lines, avg_delay_all, avg_delay_late, late_rate``.

    Tenure is the calendar span from first to last month of order
    (``basis='active'``: the number of months with a sale). Both
    averages are line-weighted: over all delivered lines, and over the late
    ones only. Descriptive: survivorship makes long tenure look better.
    """
    bucketed = profile.withColumn("bucket", tenure_bucket(_tenure(basis), long_months))
    return (bucketed.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("sellers"),
                 F.sum("delivered").cast("long").alias("lines"),
                 F.sum("delay_sum").alias("_d"),
                 F.sum("late").alias("_l"),
                 F.sum("late_delay_sum").alias("_ld"))
            .select("bucket", "sellers", "lines",
                    ratio("_d", "lines").alias("avg_delay_all"),
                    ratio("_ld", "_l").alias("avg_delay_late"),
                    ratio("_l", "lines").alias("late_rate")))


def tenure_gap(profile: DataFrame, long_months: int = 13, basis: str = "span") -> DataFrame:
    """One row: average delay of one-off sellers minus that of sellers
    active ``long_months``+ months, over all delivered lines and over late
    lines (positive = long-tenure sellers deliver with less delay)."""
    t = _tenure(basis)
    one, lng = t <= 1, t >= long_months

    def part(cond: Column, col: str) -> Column:
        return F.sum(F.when(cond, F.col(col)))

    return (profile.agg(
        ratio(part(one, "delay_sum"), part(one, "delivered")).alias("one_off_all"),
        ratio(part(lng, "delay_sum"), part(lng, "delivered")).alias("long_all"),
        ratio(part(one, "late_delay_sum"), part(one, "late")).alias("one_off_late"),
        ratio(part(lng, "late_delay_sum"), part(lng, "late")).alias("long_late"))
        .withColumns({"gap_all": F.col("one_off_all") - F.col("long_all"),
                      "gap_late": F.col("one_off_late") - F.col("long_late")}))


def good_seller_badge(profile: DataFrame, long_months: int = 13,
                      max_late_rate: float = 0.05, basis: str = "span") -> DataFrame:
    """Sellers active ``long_months``+ months whose late rate is at most
    ``max_late_rate`` (sellers with nothing delivered have no rate)."""
    return (profile.where((_tenure(basis) >= long_months)
                          & (F.col("late_rate") <= max_late_rate))
            .select("seller_id", "tenure", "delivered", "late", "late_rate",
                    money_out("revenue").alias("revenue")))
