"""A9: survival of cohorts by the product-limit estimator, and the log-rank test.

``retention`` asks who sells in one month; survival asks how long sellers go on.
A seller stops when its last sale is ``grace`` months or more before the data's end;
otherwise its end is not known yet and it is censored at its last sale. Sellers are
reduced to counts per (label, months since the first sale) in one aggregate; what follows works on these
few rows (labels x months).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import ratio
from .cohorts import EXCELLENT, SEVERE

ROUND = 9  # products and sums of doubles differ in the last bits


def seller_lifetimes(profile: DataFrame, cohorts: DataFrame, grace: int = 3) -> DataFrame:
    """``label, k, stopped`` per seller: months from its first to its last sale, and whether it stopped."""
    data_last = profile.agg(F.max("last_m")).first()[0]
    ends = profile.select("seller_id", (F.col("last_m") - F.col("first_m")).cast("int").alias("k"),
                          (F.lit(data_last) - F.col("last_m") >= grace).alias("stopped"))
    return ends.join(cohorts.select("seller_id", "label"), "seller_id").select("seller_id", "label", "k", "stopped")


def risk_sets(lifetimes: DataFrame) -> DataFrame:
    """``label, k, at_risk, stopped, censored``: sellers whose lifetime is k or more, and what became of those of k.
    A seller that is censored at k counts as at risk there."""
    ends = lifetimes.groupBy("label", "k").agg(
        F.count(F.when(F.col("stopped"), 1)).alias("stopped"),
        F.count(F.when(~F.col("stopped"), 1)).alias("censored"))
    later = Window.partitionBy("label").orderBy(F.desc("k"))
    return ends.withColumn("at_risk", F.sum(F.col("stopped") + F.col("censored")).over(later).cast("long"))


def cohort_survival(profile: DataFrame, cohorts: DataFrame, grace: int = 3) -> DataFrame:
    """``label, k, at_risk, stopped, censored, survival, std_err, low, high``
    for the months k at which a seller of the label stopped or was censored.

    ``survival``: the product-limit estimate that a seller goes on selling
    after month k; ``std_err`` by Greenwood's formula, and the 95 % limits
    cut at 0 and 1. Where all that are at risk stop, survival is 0 and has no error."""
    sets = risk_sets(seller_lifetimes(profile, cohorts, grace))
    upto = Window.partitionBy("label").orderBy("k")
    n, d = F.col("at_risk").cast("double"), F.col("stopped").cast("double")
    none_left = F.max((F.col("stopped") == F.col("at_risk")).cast("int")).over(upto) == 1
    log_share = F.when(F.col("stopped") < F.col("at_risk"), F.log(1 - d / n))
    survival = F.when(none_left, F.lit(0.0)).otherwise(F.exp(F.sum(log_share).over(upto)))
    greenwood = F.sum(F.when(F.col("stopped") < F.col("at_risk"), d / (n * (n - d)))).over(upto)
    rows = sets.select("*", survival.alias("s"), F.when(~none_left, survival * F.sqrt(greenwood)).alias("e"))
    s, e = F.col("s"), F.col("e")
    return rows.select("label", "k", "at_risk", "stopped", "censored",
                       F.round(s, ROUND).alias("survival"), F.round(e, ROUND).alias("std_err"),
                       F.round(F.greatest(F.lit(0.0), s - 1.96 * e), ROUND).alias("low"),
                       F.round(F.least(F.lit(1.0), s + 1.96 * e), ROUND).alias("high"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a polynomial that is exact to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    # Coefficients of the approximation of erfc, highest power first.
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-x * x)


def cohort_logrank(profile: DataFrame, cohorts: DataFrame, first: str = EXCELLENT, second: str = SEVERE,
                   grace: int = 3) -> DataFrame:
    """One row: do the sellers of two labels stop at the same pace?
    ``first_stopped`` and ``first_expected`` (if they did), the same of the second label, the ``variance``,
    ``chi_square`` and ``p_value`` (6 places) of the log-rank test.

    At each month the sellers at risk of both labels are needed, also where
    only one label has an end; they follow from the counts by a running sum
    over the months of both."""
    ends = seller_lifetimes(profile, cohorts, grace).where(F.col("label").isin(first, second)).groupBy("k").agg(
        *[F.count(F.when((F.col("label") == name), 1)).alias(f"all{i}") for i, name in enumerate((first, second))],
        *[F.count(F.when((F.col("label") == name) & F.col("stopped"), 1)).alias(f"d{i}")
          for i, name in enumerate((first, second))])
    later = Window.orderBy(F.desc("k"))  # one row per month of both labels
    sets = ends.withColumns({f"n{i}": F.sum(f"all{i}").over(later).cast("double") for i in (0, 1)})
    n, d = F.col("n0") + F.col("n1"), (F.col("d0") + F.col("d1")).cast("double")
    expected = d * F.col("n0") / n
    variance = F.when(n > 1, d * (F.col("n0") / n) * (F.col("n1") / n) * (n - d) / (n - 1)).otherwise(F.lit(0.0))
    total = sets.agg(F.sum("d0").cast("long").alias("first_stopped"), F.sum(expected).alias("e0"),
                     F.sum("d1").cast("long").alias("second_stopped"), F.sum(d - expected).alias("e1"),
                     F.sum(variance).alias("v"))
    chi = ratio((F.col("first_stopped") - F.col("e0")) * (F.col("first_stopped") - F.col("e0")), "v")
    return total.select("first_stopped", F.round("e0", 6).alias("first_expected"),
                        "second_stopped", F.round("e1", 6).alias("second_expected"),
                        F.round("v", 6).alias("variance"), F.round(chi, 6).alias("chi_square"),
                        F.round(normal_tail(F.sqrt(chi)), 6).alias("p_value"))
