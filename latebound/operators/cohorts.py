"""A8: first-month cohorts; A9: their retention; A12: the new-seller watch-list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_index, month_label
from ..functions.rates import money_out, ratio

# Cohort labels.
EXCELLENT, NORMAL, SEVERE, UNRATED = "excellent", "normal", "severe", "unrated"


def first_month_label(rate, excellent_max: float, severe_min: float):
    return (F.when(rate.isNull(), F.lit(UNRATED))
            .when(rate <= excellent_max, F.lit(EXCELLENT))
            .when(rate >= severe_min, F.lit(SEVERE))
            .otherwise(F.lit(NORMAL)))


def first_month_cohorts(profile: DataFrame, excellent_max: float = 0.0,
                        severe_min: float = 0.5) -> DataFrame:
    """One row per seller: its first month of sales, that month's delivered
    and late lines, the late rate and the label (``excellent`` at most
    ``excellent_max``, ``severe`` at least ``severe_min``, ``normal``
    between, ``unrated`` when nothing of that month was delivered)."""
    rate = ratio("first_late", "first_delivered")
    label = first_month_label(rate, excellent_max, severe_min)
    return profile.select(
        "seller_id", "first_m",
        month_label("first_m").alias("first_month"),
        F.col("first_delivered").alias("delivered"),
        F.coalesce(F.col("first_late"), F.lit(0)).cast("long").alias("late"),
        rate.alias("rate"),
        label.alias("label"),
        money_out("first_revenue").alias("first_revenue"))


def signup_month_cohorts(sm: DataFrame, signups: DataFrame, signup_col: str = "signed_up_at",
                         excellent_max: float = 0.0, severe_min: float = 0.5) -> DataFrame:
    """Cohorts by the month of sign-up, for data that has it (``signups``:
    ``seller_id`` and a sign-up timestamp). That month's figures come from
    :func:`seller_month` by an equi-join on (seller, month); a seller with
    no sale in its sign-up month is ``unrated``. Same columns as
    :func:`first_month_cohorts`, so :func:`cohort_retention` takes either."""
    start = signups.select("seller_id", month_index(F.col(signup_col)).alias("first_m"))
    month = sm.select("seller_id", F.col("m_idx").alias("first_m"), "delivered", "late", "revenue")
    joined = start.join(month, ["seller_id", "first_m"], "left")
    delivered = F.coalesce(F.col("delivered"), F.lit(0)).cast("long")
    rate = ratio(F.col("late"), delivered)
    return joined.select(
        "seller_id", "first_m",
        month_label("first_m").alias("first_month"),
        delivered.alias("delivered"),
        F.coalesce(F.col("late"), F.lit(0)).cast("long").alias("late"),
        rate.alias("rate"),
        first_month_label(rate, excellent_max, severe_min).alias("label"),
        money_out(F.coalesce(F.col("revenue"), F.lit(0).cast("decimal(22,2)"))).alias("first_revenue"))


def cohort_retention(sm: DataFrame, cohorts: DataFrame, horizon: int | None = 24) -> DataFrame:
    """``label, k, cohort_size, observable, active, retention,
    retention_observable`` for month offsets ``k`` since the first sale.

    ``active``: sellers of the label with a sale in month first+k (from the
    distinct seller-months, never from lines). ``retention`` divides by the
    fixed cohort size; ``retention_observable`` by the sellers whose month
    first+k is not after the data's last month (right censoring).

    With ``horizon`` every k in 0..horizon appears (zero months included);
    without it only offsets with activity appear. The seller-months are read
    for one aggregate by (label, first month, k); with the cohort sizes by
    (label, first month) it holds all that follows, at most labels x months
    x months rows. Write ``cohorts`` first (it is read twice).
    """
    data_last = sm.agg(F.max("m_idx")).first()[0]
    members = cohorts.select("seller_id", "first_m", "label")
    k = (F.col("m_idx") - F.col("first_m")).cast("int")
    active = (sm.select("seller_id", "m_idx").join(members, "seller_id").withColumn("k", k)
              .groupBy("label", "first_m", "k").agg(F.count(F.lit(1)).alias("active"))
              .groupBy("label", "k").agg(F.sum("active").alias("active")))
    sizes = members.groupBy("label", "first_m").agg(F.count(F.lit(1)).alias("n"))
    # a first month is observable at the offsets up to the data's last month
    last_k = (F.lit(data_last) - F.col("first_m")).cast("int")
    top = F.lit(horizon) if horizon is not None else F.greatest(last_k, F.lit(0))
    spine = (sizes.withColumn("k", F.explode(F.sequence(F.lit(0), top)))
             .groupBy("label", "k").agg(F.sum(F.when(F.col("k") <= last_k, F.col("n"))).alias("observable")))
    totals = sizes.groupBy("label").agg(F.sum("n").alias("cohort_size"))
    how = "left" if horizon is not None else "right"
    rows = spine.join(active, ["label", "k"], how).join(totals, "label")
    act = F.coalesce(F.col("active"), F.lit(0)).cast("long")
    observable = F.coalesce(F.col("observable"), F.lit(0)).cast("long")
    return rows.select(
        "label", "k",
        F.col("cohort_size").cast("long").alias("cohort_size"),
        observable.alias("observable"),
        act.alias("active"),
        ratio(act, "cohort_size").alias("retention"),
        ratio(act, observable).alias("retention_observable"))


def long_term_retention(retention: DataFrame, k: int = 12) -> DataFrame:
    """The retention table at one offset (``k = 12``: still selling a year
    after the first sale), one row per label."""
    return retention.where(F.col("k") == k)


def new_seller_watchlist(cohorts: DataFrame, min_delivered: int = 2) -> DataFrame:
    """Sellers whose first month was ``severe`` on at least
    ``min_delivered`` delivered lines: candidates for early monitoring."""
    return (cohorts.where((F.col("label") == SEVERE) & (F.col("delivered") >= min_delivered))
            .select("seller_id", "first_month", "delivered", "late", "rate", "first_revenue"))
