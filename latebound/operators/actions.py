"""A10: revenue ranking with habitual late dispatchers moved down; A11:
product groups where bulky items drive seller-caused delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import count_true, money_out, ratio
from ..session import materialize
from ..schema import PRODUCTS, validate
from .deciles import volume
from .facts import SELLER
from .ranking import global_row_number

# Size bands.
BULKY, REGULAR, UNKNOWN_SIZE = "bulky", "regular", "unknown"


def seller_penalty_ranking(profile: DataFrame, max_dispatch_rate: float = 0.4,
                           min_lines: int = 5, rows_per_range: int | None = None) -> DataFrame:
    """``seller_id, revenue, dispatch_lines, dispatch_late_rate, penalized,
    base_rank, adjusted_rank, rank_change``.

    ``base_rank`` orders by revenue (descending, ties by id). A seller with
    at least ``min_lines`` dispatch-known lines and a dispatch-late rate of
    at least ``max_dispatch_rate`` is penalized: ``adjusted_rank`` puts all
    penalized sellers after the others, revenue order inside each block.
    Both ranks are global row numbers computed range by range (no
    single-partition window).
    """
    rate = ratio("dispatch_late", "dispatch_known")
    base = profile.select(
        "seller_id", "revenue",
        F.col("dispatch_known").alias("dispatch_lines"),
        rate.alias("dispatch_late_rate"),
        F.when((F.col("dispatch_known") >= min_lines) & (rate >= max_dispatch_rate), 1)
        .otherwise(0).alias("penalized"))
    base = materialize(base, "penalty_base")
    kw = {} if rows_per_range is None else {"rows_per_range": rows_per_range}
    ranked, n = global_row_number(base, [("revenue", False), ("seller_id", True)],
                                  out="base_rank", **kw)
    ranked, _ = global_row_number(ranked, [("penalized", True), ("revenue", False),
                                           ("seller_id", True)], out="adjusted_rank",
                                  n_rows=n, source=base, **kw)
    return ranked.select(
        "seller_id", money_out("revenue").alias("revenue"), "dispatch_lines",
        "dispatch_late_rate", F.col("penalized").cast("int").alias("penalized"),
        "base_rank", "adjusted_rank",
        (F.col("adjusted_rank") - F.col("base_rank")).alias("rank_change"))


def fulfilment_priority_groups(attributed: DataFrame, products: DataFrame,
                               bulk_weight: float = 35, bulk_volume: float | None = None,
                               min_share: float = 0.5) -> DataFrame:
    """``category, size_band, delivered, late, seller_late, seller_share,
    late_rate, priority`` per product group and size band.

    A product is bulky when its weight reaches ``bulk_weight`` (or its
    volume ``bulk_volume``, when given); its size is unknown only when none
    of these is known. A bulky group is a fulfilment
    priority when the seller causes at least ``min_share`` of its late
    lines and more than in the same category's regular band.
    Lines are reduced per product before the join with the product table.
    """
    per_product = (attributed.groupBy("product_id")
                   .agg(F.count("late").alias("delivered"),
                        count_true(F.col("late") == 1).alias("late"),
                        count_true(F.col("cause") == SELLER).alias("seller_late")))
    validate(products, PRODUCTS, "products")
    limits = [(F.col("weight"), bulk_weight)] + ([] if bulk_volume is None else [(volume(), bulk_volume)])
    is_bulky, known = F.lit(False), F.lit(False)
    for size, limit in limits:
        is_bulky = is_bulky | F.coalesce(size >= limit, F.lit(False))
        known = known | size.isNotNull()
    band = (F.when(is_bulky, F.lit(BULKY)).when(known, F.lit(REGULAR))
            .otherwise(F.lit(UNKNOWN_SIZE)))
    specs = products.select("product_id", "category", band.alias("size_band"))
    groups = (per_product.join(specs, "product_id", "left")
              .groupBy("category", "size_band")
              .agg(F.sum("delivered").cast("long").alias("delivered"),
                   F.sum("late").cast("long").alias("late"),
                   F.sum("seller_late").cast("long").alias("seller_late"))
              .withColumns({"seller_share": ratio("seller_late", "late"),
                            "late_rate": ratio("late", "delivered")}))
    in_category = Window.partitionBy("category")
    regular_share = F.max(F.when(F.col("size_band") == REGULAR, F.col("seller_share"))).over(in_category)
    return groups.withColumn(
        "priority",
        F.when((F.col("size_band") == BULKY) & (F.col("seller_share") >= min_share)
               & (F.col("seller_share") > F.coalesce(regular_share, F.lit(-1.0))), 1)
        .otherwise(0).cast("int"))
