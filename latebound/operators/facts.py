"""Line-grain facts (lateness, responsibility) and the shared seller-month
aggregate that most seller analyses start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_diff, month_index
from ..functions.rates import count_true, int_sum, money_out, money_sum, ratio
from ..schema import FULFILMENT_LINES, validate

# The responsibility labels.
SELLER, CARRIER, UNKNOWN, ABSORBED, ON_TIME, UNDELIVERED = (
    "seller", "carrier", "unknown", "absorbed", "on_time", "undelivered")
CAUSES = (ON_TIME, ABSORBED, SELLER, CARRIER, UNKNOWN, UNDELIVERED)


def enrich(lines: DataFrame, granularity: str = "day") -> DataFrame:
    """Add the per-line measures every analysis uses.

    ``dispatch_delay`` days from the seller's deadline to the hand-over,
    ``delivery_delay`` days from the promised date to the delivery (NULL if
    not delivered), the flags ``late`` / ``dispatch_late`` (1/0/NULL),
    ``ship_days`` (order to hand-over) and the month index ``m_idx``.
    ``granularity='day'`` calls a line late when it arrives on a later
    calendar day than promised; ``'second'`` compares the timestamps.
    A pure projection: no shuffle, fused into the scan's codegen stage.
    """
    validate(lines, FULFILMENT_LINES, "fulfilment_lines")
    dispatch_delay = day_diff("shipped_at", "ship_limit_at")
    delivery_delay = day_diff("delivered_at", "estimated_at")
    if granularity == "day":
        is_late, is_dispatch_late = delivery_delay > 0, dispatch_delay > 0
    elif granularity == "second":
        is_late = F.col("delivered_at") > F.col("estimated_at")
        is_dispatch_late = F.col("shipped_at") > F.col("ship_limit_at")
    else:
        raise ValueError(f"granularity must be day or second, not {granularity!r}")
    return lines.select(
        "*",
        dispatch_delay.alias("dispatch_delay"),
        delivery_delay.alias("delivery_delay"),
        F.when(delivery_delay.isNotNull(), is_late.cast("int")).alias("late"),
        F.when(dispatch_delay.isNotNull(), is_dispatch_late.cast("int")).alias("dispatch_late"),
        day_diff("shipped_at", "ordered_at").alias("ship_days"),
        month_index("ordered_at").alias("m_idx"))


def delay_attribution(lines: DataFrame) -> DataFrame:
    """Label each line with the party responsible for its delay (``cause``)
    and split the late days between seller and carrier.

    Late and dispatched late: ``seller``; late but dispatched in time:
    ``carrier``; late with an unknown dispatch: ``unknown``; dispatched late
    but delivered in time: ``absorbed``; otherwise ``on_time``; not
    delivered: ``undelivered``. The seller owns at most the days it
    dispatched late, the carrier the rest of the delivery delay; both are
    NULL where the dispatch is unknown, so nobody is charged for those days.
    """
    if "late" not in lines.columns:
        lines = enrich(lines)
    late, dlate = F.col("late"), F.col("dispatch_late")
    cause = (F.when(late.isNull(), F.lit(UNDELIVERED))
             .when((late == 1) & (dlate == 1), F.lit(SELLER))
             .when((late == 1) & (dlate == 0), F.lit(CARRIER))
             .when(late == 1, F.lit(UNKNOWN))
             .when(dlate == 1, F.lit(ABSORBED))
             .otherwise(F.lit(ON_TIME)))
    seller_days = F.when((late == 1) & dlate.isNotNull(), F.least(F.col("delivery_delay"),
                                            F.greatest(F.col("dispatch_delay"), F.lit(0))))
    return lines.select("*", cause.alias("cause"), seller_days.alias("seller_days"),
                        (F.col("delivery_delay") - seller_days).alias("carrier_days"))


def attribution_summary(attributed: DataFrame) -> DataFrame:
    """Lines, sellers, revenue and delay days per cause.

    Grouping by a handful of causes is safe under skew: the partial
    aggregate on each map task leaves one row per cause (and per
    (cause, seller) for the distinct count) before the shuffle.
    """
    return (attributed.groupBy("cause")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.countDistinct("seller_id").alias("sellers"),
                 money_out(money_sum("price")).alias("revenue"),
                 int_sum("delivery_delay").alias("delay_days"),
                 int_sum("seller_days").alias("seller_days"),
                 int_sum("carrier_days").alias("carrier_days")))


def seller_month(attributed: DataFrame) -> DataFrame:
    """One row per (seller, month of order): the shared base aggregate.

    Every column is partial-aggregable, so a seller holding a third of all
    lines is reduced map-side before the shuffle. ``orders`` is a distinct
    count; it adds up over a seller's months because an order has one
    order month (it does not add up over sellers).
    """
    if "cause" not in attributed.columns:
        attributed = delay_attribution(attributed)
    return (attributed.groupBy("seller_id", "m_idx")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.countDistinct("order_id").alias("orders"),
                 money_sum("price").alias("revenue"),
                 F.count("late").alias("delivered"),
                 count_true(F.col("late") == 1).alias("late"),
                 count_true(F.col("cause") == SELLER).alias("seller_late"),
                 count_true(F.col("cause") == CARRIER).alias("carrier_late"),
                 F.count("dispatch_late").alias("dispatch_known"),
                 count_true(F.col("dispatch_late") == 1).alias("dispatch_late"),
                 int_sum("delivery_delay").alias("delay_sum"),
                 int_sum(F.when(F.col("late") == 1, F.col("delivery_delay"))).alias("late_delay_sum")))


def seller_profile(sm: DataFrame) -> DataFrame:
    """One row per seller from :func:`seller_month`: first/last month,
    calendar tenure, totals, and the first month's delivery record.

    ``min_by`` picks the first month's figures inside the same
    partial-aggregable hash aggregate (no window, no self-join).
    """
    # one min_by per fixed-width value (a struct buffer would force a
    # sort-based aggregate); revenue travels as exact cents
    cents = (F.col("revenue") * 100).cast("long")
    return (sm.groupBy("seller_id")
            .agg(F.min("m_idx").alias("first_m"),
                 F.max("m_idx").alias("last_m"),
                 F.count(F.lit(1)).alias("active_months"),
                 F.sum("lines").cast("long").alias("lines"),
                 F.sum("orders").cast("long").alias("orders"),
                 F.sum("revenue").alias("revenue"),
                 F.sum("delivered").cast("long").alias("delivered"),
                 F.sum("late").cast("long").alias("late"),
                 F.sum("seller_late").cast("long").alias("seller_late"),
                 F.sum("carrier_late").cast("long").alias("carrier_late"),
                 F.sum("dispatch_known").cast("long").alias("dispatch_known"),
                 F.sum("dispatch_late").cast("long").alias("dispatch_late"),
                 F.sum("delay_sum").cast("long").alias("delay_sum"),
                 F.sum("late_delay_sum").cast("long").alias("late_delay_sum"),
                 F.min_by("delivered", "m_idx").cast("long").alias("first_delivered"),
                 F.min_by("late", "m_idx").cast("long").alias("first_late"),
                 F.min_by(cents, "m_idx").alias("_first_cents"))
            .select("*",
                    (F.col("last_m") - F.col("first_m") + 1).cast("int").alias("tenure"),
                    (F.col("_first_cents").cast("decimal(20,0)") / 100).cast("decimal(22,2)")
                    .alias("first_revenue"),
                    ratio("late", "delivered").alias("late_rate"))
            .drop("_first_cents"))
