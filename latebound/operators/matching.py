"""A7/A13: one-off and long-tenure sellers compared like with like, by coarsened exact matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import ratio
from .tenure import _tenure

ROUND = 9


def main_category(attributed: DataFrame, products: DataFrame) -> DataFrame:
    """Per seller the category with most of its lines (ties: the first by name). Lines are counted per (seller,
    product) before the product join."""
    pairs = attributed.groupBy("seller_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    per = (pairs.join(products.select("product_id", "category"), "product_id", "left")
           .groupBy("seller_id", "category").agg(F.sum("n").alias("n")))
    return per.groupBy("seller_id").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("category", F.lit("")).alias("category"))).alias("m")).select(
        "seller_id", "m.category")


def tenure_gap_matched(profile: DataFrame, categories: DataFrame, sellers: DataFrame, long_months: int = 13,
                       basis: str = "span") -> DataFrame:
    """One row: the tenure gap between sellers of the same stratum, where a
    stratum is state, main category and the number of digits of the revenue per active month.

    In each stratum with sellers of both kinds, one-off sellers' average delay
    (over delivered lines; ``_late``: over late ones) less that of the long-tenure sellers; strata are
    weighted by their long-tenure sellers. ``unmatched_one_off`` and ``unmatched_long`` are the shares of sellers in
    strata without a counterpart; they do not enter. Strata without delivered (late) lines on either side
    have no gap and no weight. Descriptive: what the strata do not hold stays confounded."""
    t = _tenure(basis)
    ends = profile.where((t <= 1) | (t >= long_months)).select(
        "seller_id", (t <= 1).alias("one"), "delivered", "delay_sum", "late", "late_delay_sum",
        F.length(F.floor(F.col("revenue") / F.col("active_months")).cast("string")).alias("digits"))
    strata = (ends.join(categories, "seller_id", "left").join(sellers.select("seller_id", "state"), "seller_id", "left")
              .groupBy("state", "category", "digits").agg(
        F.count(F.when(F.col("one"), 1)).alias("n_one"), F.count(F.when(~F.col("one"), 1)).alias("n_long"),
        *[F.sum(F.when(side, F.col(c))).alias(f"{c}_{name}") for c in ("delivered", "delay_sum", "late", "late_delay_sum")
          for name, side in (("one", F.col("one")), ("long", ~F.col("one")))]))
    both = (F.col("n_one") > 0) & (F.col("n_long") > 0)
    gap_all = ratio("delay_sum_one", "delivered_one") - ratio("delay_sum_long", "delivered_long")
    gap_late = ratio("late_delay_sum_one", "late_one") - ratio("late_delay_sum_long", "late_long")
    rows = strata.withColumns({"both": both, "g": F.when(both, gap_all), "gl": F.when(both, gap_late)})
    weighted = lambda g: F.round(ratio(F.sum(F.col(g) * F.col("n_long")), F.sum(F.when(F.col(g).isNotNull(), F.col("n_long")))), ROUND)
    share = lambda n: ratio(F.sum(F.when(~F.col("both"), F.col(n)).otherwise(0)), F.sum(n))
    return rows.agg(F.count(F.when(F.col("both"), 1)).alias("strata"), F.count(F.when(~F.col("both"), 1)).alias("unmatched_strata"),
                    F.coalesce(F.sum(F.when(F.col("both"), F.col("n_one"))), F.lit(0)).cast("long").alias("one_off"),
                    F.coalesce(F.sum(F.when(F.col("both"), F.col("n_long"))), F.lit(0)).cast("long").alias("long"),
                    weighted("g").alias("gap_all"), weighted("gl").alias("gap_late"),
                    share("n_one").alias("unmatched_one_off"), share("n_long").alias("unmatched_long"))
