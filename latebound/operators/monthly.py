"""A0: monthly revenue and the share of it (and of orders) hit by late delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.rates import count_true, money_out, money_sum, ratio


def late_revenue_monthly(attributed: DataFrame) -> DataFrame:
    """``month, revenue, late_revenue, orders, late_orders, late_order_share,
    late_revenue_share, revenue_growth`` per month of order.

    An order is late when any of its lines is late; ``late_revenue`` sums
    the late *lines* only. Lines are first reduced to one row per order
    (all lines of an order share its month), which replaces a distinct
    count with a plain count; the month-level result is tiny, so the
    month-over-month ``lag`` runs on at most a few hundred rows.
    """
    per_order = (attributed.groupBy("order_id", "m_idx")
                 .agg(money_sum("price").alias("revenue"),
                      money_sum(F.when(F.col("late") == 1, F.col("price"))).alias("late_revenue"),
                      F.max("late").alias("any_late")))
    monthly = (per_order.groupBy("m_idx")
               .agg(F.sum("revenue").alias("revenue"),
                    F.coalesce(F.sum("late_revenue"), F.lit(0).cast("decimal(12,2)")).alias("late_revenue"),
                    F.count(F.lit(1)).alias("orders"),
                    count_true(F.col("any_late") == 1).alias("late_orders")))
    by_month = Window.orderBy("m_idx")
    # growth only against the month before: a gap of months has none
    previous = F.when(F.lag("m_idx").over(by_month) == F.col("m_idx") - 1, F.lag("revenue").over(by_month))
    return monthly.select(
        month_label("m_idx").alias("month"),
        money_out("revenue").alias("revenue"),
        money_out("late_revenue").alias("late_revenue"),
        F.col("orders").cast("long").alias("orders"),
        F.col("late_orders").cast("long").alias("late_orders"),
        ratio("late_orders", "orders").alias("late_order_share"),
        ratio("late_revenue", "revenue").alias("late_revenue_share"),
        (ratio("revenue", previous) - 1).alias("revenue_growth"),
    )
