"""A0: is the late share growing? A rank test, a robust slope and a change point of a monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .survival import normal_tail

ROUND = 9


def late_revenue_trend(monthly: DataFrame, measures: tuple[str, ...] = ("late_order_share", "late_revenue_share")) -> DataFrame:
    """One row per measure of :func:`late_revenue_monthly`: ``measure, months,
    kendall_s, z, p_value, slope, change_month, shift``.

    Mann-Kendall: ``kendall_s`` counts rising less falling pairs of months,
    ``z`` its normal score (variance corrected for ties, continuity by one).
    ``slope`` is the median of the pairs' slopes per month (Theil and Sen), by
    calendar distance, so a gap of months counts as such. ``change_month`` is the
    first month after the largest absolute cumulative sum of deviations from the mean, and
    ``shift`` the mean from that month on less the mean before it. Months
    without the measure are left out; all steps work on the monthly rows, at most a few hundred."""
    cols = ", ".join(f"'{m}', {m}" for m in measures)
    series = monthly.select("month", F.expr(f"stack({len(measures)}, {cols}) AS (measure, y)")).where(F.col("y").isNotNull())
    number = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    series = series.select("measure", "month", number.alias("t"), "y")
    a, b = series.alias("a"), series.alias("b")
    pairs = a.join(b, (F.col("a.measure") == F.col("b.measure")) & (F.col("a.t") < F.col("b.t"))).select(
        F.col("a.measure").alias("measure"), (F.col("b.y") - F.col("a.y")).alias("dy"), (F.col("b.t") - F.col("a.t")).alias("dt"))
    kendall = pairs.groupBy("measure").agg(
        F.sum(F.signum("dy")).cast("long").alias("s"), F.round(F.percentile(F.col("dy") / F.col("dt"), F.lit(0.5)), ROUND).alias("slope"))
    ties = series.groupBy("measure", "y").agg(F.count(F.lit(1)).alias("c")).groupBy("measure").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("tied"))
    n, s = F.col("n"), F.col("s")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18
    z = F.when(variance > 0, (s - F.signum(s.cast("double"))) / F.sqrt(variance.cast("double")))
    # deviations and their running sum; what is compared is rounded, so other engines' sums choose the same month
    whole = Window.partitionBy("measure")
    upto = whole.orderBy("t")
    summed = series.withColumn("d", F.col("y") - F.avg("y").over(whole)).withColumn("cusum", F.round(F.abs(F.sum("d").over(upto)), ROUND))
    last = F.max_by("t", F.struct("cusum", -F.col("t"))).alias("at")
    breaks = summed.groupBy("measure").agg(last)
    sides = series.join(breaks, "measure").groupBy("measure").agg(
        F.min(F.when(F.col("t") > F.col("at"), F.col("month"))).alias("change_month"),
        F.round(F.avg(F.when(F.col("t") > F.col("at"), F.col("y"))) - F.avg(F.when(F.col("t") <= F.col("at"), F.col("y"))), ROUND).alias("shift"))
    return ties.join(kendall, "measure", "left").join(sides, "measure").select(
        "measure", n.cast("long").alias("months"), F.coalesce(s, F.lit(0)).cast("long").alias("kendall_s"),
        F.round(z, ROUND).alias("z"), F.round(normal_tail(z), 6).alias("p_value"), "slope", "change_month", "shift")
