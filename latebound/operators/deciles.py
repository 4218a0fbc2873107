"""A5: deciles of the seller-caused share of delays, profiled by product
weight, volume and dispatch time; A6: the matching correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import correlation, count_true, ratio
from ..session import materialize
from ..schema import PRODUCTS, validate
from .facts import SELLER
from .ranking import ntile

ROUND = 6  # doubles averaged in different orders differ in the last bits


def volume() -> Column:
    """length * width * height in doubles: fractions stay, and integer sides do not overflow."""
    return F.col("length").cast("double") * F.col("width").cast("double") * F.col("height").cast("double")


def blame_by_grain(attributed: DataFrame, products: DataFrame, grain: str = "seller_id",
                   min_late: int = 1) -> DataFrame:
    """Per ``grain`` (``seller_id`` or ``category``): late lines, seller-caused
    late lines, ``blame_share``, and the line-weighted mean ``avg_weight``,
    ``avg_volume`` (length*width*height) and ``avg_ship_days``. Grains with
    fewer than ``min_late`` late lines have no share and are dropped.

    Lines are reduced to (grain, product) before the product join (to the
    product alone where the grain is a product column), so the join shuffles
    pre-aggregated rows, not the fact; a missing product keeps its lines with
    NULL specs (skipped by the means).
    """
    keys = ["product_id"] if grain == "category" else [grain, "product_id"]
    per_pair = (attributed.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n"),
                     F.sum("ship_days").cast("long").alias("ship_sum"),
                     F.count("ship_days").alias("ship_n"),
                     count_true(F.col("late") == 1).alias("late"),
                     count_true(F.col("cause") == SELLER).alias("seller_late")))
    validate(products, PRODUCTS, "products")
    specs = products.select("product_id", "category", F.col("weight").cast("double").alias("weight"),
                            volume().alias("volume"))
    joined = per_pair.join(specs, "product_id", "left")
    n = F.col("n")
    per_grain = (joined.groupBy(grain)
                 .agg(F.sum("late").cast("long").alias("late"),
                      F.sum("seller_late").cast("long").alias("seller_late"),
                      F.sum(F.col("weight") * n).alias("_w"),
                      F.sum(F.when(F.col("weight").isNotNull(), n)).alias("_wn"),
                      F.sum(F.col("volume") * n).alias("_v"),
                      F.sum(F.when(F.col("volume").isNotNull(), n)).alias("_vn"),
                      F.sum("ship_sum").alias("_s"),
                      F.sum("ship_n").alias("_sn")))
    return (per_grain.where(F.col("late") >= F.lit(max(1, min_late)))
            .select(grain, "late", "seller_late",
                    ratio("seller_late", "late").alias("blame_share"),
                    ratio("_w", "_wn").alias("avg_weight"),
                    ratio("_v", "_vn").alias("avg_volume"),
                    ratio("_s", "_sn").alias("avg_ship_days")))


def seller_blame_shares(attributed: DataFrame, products: DataFrame, n: int = 10,
                        min_late: int = 1, grain: str = "seller_id",
                        rows_per_range: int | None = None) -> DataFrame:
    """:func:`blame_by_grain` plus ``decile`` = NTILE(n) by (share, grain id)."""
    shares = materialize(blame_by_grain(attributed, products, grain, min_late), "blame_shares")
    kw = {} if rows_per_range is None else {"rows_per_range": rows_per_range}
    return ntile(shares, n, [("blame_share", True), (grain, True)], out="decile", **kw)


def seller_blame_deciles(attributed: DataFrame, products: DataFrame, n: int = 10,
                         min_late: int = 1, grain: str = "seller_id",
                         rows_per_range: int | None = None) -> DataFrame:
    """One row per decile: members, min/max share (ties make neighbouring
    deciles meaningless, so always read them), pooled share and the
    unweighted means of the members' weight, volume and dispatch days."""
    ranked = seller_blame_shares(attributed, products, n, min_late, grain, rows_per_range)
    return (ranked.groupBy("decile")
            .agg(F.count(F.lit(1)).alias("members"),
                 F.min("blame_share").alias("min_share"),
                 F.max("blame_share").alias("max_share"),
                 F.sum("late").cast("long").alias("late_lines"),
                 F.sum("seller_late").cast("long").alias("seller_late_lines"),
                 F.round(F.avg("avg_weight"), ROUND).alias("avg_weight"),
                 F.round(F.avg("avg_volume"), ROUND).alias("avg_volume"),
                 F.round(F.avg("avg_ship_days"), ROUND).alias("avg_ship_days"))
            .withColumn("pooled_share", ratio("seller_late_lines", "late_lines")))


def shrunk_shares(shares: DataFrame) -> DataFrame:
    """:func:`blame_by_grain` rows plus ``posterior``: the share that is likely
    given few late lines, by empirical Bayes. A beta prior is fitted to all grains by
    moments: its mean is the share of all late lines, and its strength ``prior_lines`` (late lines that the
    prior is worth) follows from how much the shares, weighted by their lines, vary beyond what chance explains.
    One aggregate; a share of 1 from one line no longer ties with a share of 1 from fifty."""
    n, s = F.col("late"), F.col("seller_late")
    sums = shares.agg(F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(s).alias("s"),
                      F.sum((s * s).cast("double") / n).alias("a"))
    sums = sums.withColumn("prior_mean", F.round(ratio("s", "n"), ROUND))
    p = F.col("prior_mean")
    chance = p * (1 - p)
    spread = F.col("a") - 2 * p * F.col("s") + p * p * F.col("n")  # sum over grains of lines * (share - mean)^2
    alike = F.try_divide(spread - chance * (F.col("g") - 1), chance * (F.col("n") - ratio("nn", "n") - (F.col("g") - 1)))
    # how alike two lines of a grain are: 0 none (the prior is all), 1 fully
    rho = F.least(F.lit(0.999), F.greatest(F.lit(1e-4), F.coalesce(alike, F.lit(1e-4))))
    prior = sums.select("prior_mean", F.round(1 / rho - 1, 4).alias("prior_lines"))
    k = F.col("prior_lines")
    return shares.crossJoin(prior).withColumn(  # one row
        "posterior", F.round((F.col("seller_late") + k * p) / (F.col("late") + k), ROUND))


def seller_blame_deciles_shrunk(attributed: DataFrame, products: DataFrame, n: int = 10, min_late: int = 1,
                                grain: str = "seller_id", rows_per_range: int | None = None) -> DataFrame:
    """:func:`seller_blame_deciles` by posterior shares (:func:`shrunk_shares`):
    few grains share a value, so neighbouring deciles differ; ``tied_below`` tells whether the decile
    begins with the value that the one before ends with."""
    shares = materialize(shrunk_shares(materialize(blame_by_grain(attributed, products, grain, min_late), "blame_shares")),
                         "blame_posteriors")
    kw = {} if rows_per_range is None else {"rows_per_range": rows_per_range}
    ranked = ntile(shares, n, [("posterior", True), (grain, True)], out="decile", **kw)
    rows = (ranked.groupBy("decile")
            .agg(F.count(F.lit(1)).alias("members"), F.min("posterior").alias("min_posterior"),
                 F.max("posterior").alias("max_posterior"),
                 F.sum("late").cast("long").alias("late_lines"), F.sum("seller_late").cast("long").alias("seller_late_lines"),
                 F.round(F.avg("avg_weight"), ROUND).alias("avg_weight"), F.round(F.avg("avg_volume"), ROUND).alias("avg_volume"),
                 F.round(F.avg("avg_ship_days"), ROUND).alias("avg_ship_days"),
                 F.max("prior_mean").alias("prior_mean"), F.max("prior_lines").alias("prior_lines"))
            .withColumn("pooled_share", ratio("seller_late_lines", "late_lines")))
    before = F.lag("max_posterior").over(Window.orderBy("decile"))  # n rows
    return rows.withColumn("tied_below", F.coalesce(before == F.col("min_posterior"), F.lit(False)).cast("int"))


def spec_delay_correlation(attributed: DataFrame, products: DataFrame, min_late: int = 1,
                           grain: str = "seller_id") -> DataFrame:
    """Pearson coefficients over the grains that have a blame share:
    share~weight, share~volume, weight~dispatch days, share~dispatch days.
    Descriptive only: tenure, category and size are confounded."""
    g = blame_by_grain(attributed, products, grain, min_late)
    return g.agg(
        F.round(correlation("blame_share", "avg_weight"), ROUND).alias("share_weight"),
        F.round(correlation("blame_share", "avg_volume"), ROUND).alias("share_volume"),
        F.round(correlation("avg_weight", "avg_ship_days"), ROUND).alias("weight_dispatch"),
        F.round(correlation("blame_share", "avg_ship_days"), ROUND).alias("share_dispatch"),
        F.count(F.lit(1)).alias("grains"))
