"""A1: RFM scores per seller and the top-revenue sellers with habitual delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import money_out, ratio
from ..session import materialize
from .ranking import bin_of, bin_starts, rows_at


def rfm_scores(profile: DataFrame, tiers: int = 5, basis: str = "any",
               rows_per_range: int | None = None) -> DataFrame:
    """Per seller: ``recency`` (months from its last order to the data's
    last order), ``frequency`` (distinct orders), ``monetary`` (revenue),
    their NTILE scores (``tiers`` is best; ties broken by ``seller_id``),
    ``revenue_share`` and the lateness record.

    ``basis='any'`` counts every late line; ``'caused'`` only the lines
    whose delay the seller caused.
    """
    late_col = {"any": "late", "caused": "seller_late"}[basis]
    base = profile.select(
        "seller_id", "last_m",
        F.col("orders").alias("frequency"),
        F.col("revenue").alias("monetary"),
        "delivered",
        F.col(late_col).alias("late_lines"))
    base = materialize(base, "rfm_base")
    totals = base.agg(F.max("last_m").alias("data_last"), F.sum("monetary").alias("total"),
                      F.count(F.lit(1)).alias("n")).first()
    data_last, total = totals["data_last"], totals["total"]
    base = base.withColumn("recency", (F.lit(data_last) - F.col("last_m")).cast("int"))
    n = totals["n"]
    kw = {} if rows_per_range is None else {"rows_per_range": rows_per_range}
    # The three orders are one: (score, key, seller). It is ranged and written once, thin, and the first
    # sellers of all tiers are read at their positions in it; scores are comparisons with them.
    keys = [-F.col("recency"), F.col("frequency"), F.col("monetary")]
    thin = base.select("seller_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("score"), k.cast("decimal(24,2)").alias("key")) for i, k in enumerate(keys)])).alias("s")
    ).select("s.score", "s.key", "seller_id")
    positions = [i * n + p for i in range(len(keys)) for p in bin_starts(n, tiers)]
    edges = rows_at(thin, [("score", True), ("key", True), ("seller_id", True)], positions, n_rows=len(keys) * n, **kw)
    scored = base.select("*", *[
        bin_of([(k.cast("decimal(24,2)"), True), (F.col("seller_id"), True)],
               [(e["key"], e["seller_id"]) for e in edges if e["score"] == i]).alias(name)
        for i, (k, name) in enumerate(zip(keys, ("r_score", "f_score", "m_score")))])
    return scored.select(
        "seller_id", "recency",
        F.col("frequency").cast("long").alias("frequency"),
        money_out("monetary").alias("monetary"),
        ratio(F.col("monetary"), F.lit(total)).alias("revenue_share"),
        "r_score", "f_score", "m_score",
        F.col("delivered").cast("long").alias("delivered"),
        F.col("late_lines").cast("long").alias("late_lines"),
        ratio("late_lines", "delivered").alias("late_rate"),
    )


def black_sellers_rfm(profile: DataFrame, tiers: int = 5, m_tier: int = 5, min_late: int = 3,
                      min_late_rate: float = 0.3, basis: str = "any",
                      rows_per_range: int | None = None) -> DataFrame:
    """Sellers in the top revenue tier(s) (``m_score >= m_tier``) that are
    habitually late (``late_lines >= min_late`` and ``late_rate >= min_late_rate``)."""
    scores = rfm_scores(profile, tiers=tiers, basis=basis, rows_per_range=rows_per_range)
    return scores.where((F.col("m_score") >= m_tier) & (F.col("late_lines") >= min_late)
                        & (F.col("late_rate") >= min_late_rate))
