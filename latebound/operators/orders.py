"""G3: exact distinct orders that add up over sellers, regions and months, as bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_label

WHOLE_IDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def order_bitmaps(attributed: DataFrame, sellers: DataFrame) -> DataFrame:
    """``state, m_idx, bucket, orders``: a bitmap of the order ids (32,768 a
    bucket) with lines of the state's sellers in the month. Bitmaps of the same
    bucket merge by ``bitmap_or_agg``, over any groups. Tasks build bitmaps before the
    shuffle, so it moves bitmaps of (state, month, bucket) instead of a row per order."""
    placed = attributed.select("seller_id", "m_idx", "order_id").join(sellers.select("seller_id", "state"), "seller_id", "left")
    return placed.groupBy("state", "m_idx", F.bitmap_bucket_number("order_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("order_id")).alias("orders"))


def orders_by_region(attributed: DataFrame, sellers: DataFrame) -> DataFrame:
    """Exact numbers of different orders per state and month, per state, and
    in total: ``state, month, level_id, orders`` (``level_id`` 0, 1, 3 as in a rollup). An order with
    sellers of two states counts in each, and once in the total, which is why plain counts do not add up.

    Whole-number order ids go through bitmaps. Other ids have none: they are counted by
    ``countDistinct`` for every level, an exchange keyed by the order."""
    ids = attributed.schema["order_id"].dataType
    if isinstance(ids, WHOLE_IDS):
        bits = order_bitmaps(attributed, sellers)
        levels = bits.groupingSets([["state", "m_idx", "bucket"], ["state", "bucket"], ["bucket"]], "state", "m_idx", "bucket").agg(
            F.bitmap_count(F.bitmap_or_agg("orders")).alias("n"),
            (F.grouping("state") * 2 + F.grouping("m_idx")).cast("int").alias("level_id"))
        counted = levels.groupBy("state", "m_idx", "level_id").agg(F.sum("n").cast("long").alias("orders"))
    else:
        placed = attributed.select("seller_id", "m_idx", "order_id").join(sellers.select("seller_id", "state"), "seller_id", "left")
        counted = placed.rollup("state", "m_idx").agg(
            F.countDistinct("order_id").alias("orders"), F.grouping_id().cast("int").alias("level_id"))
    return counted.select("state", F.when(F.col("m_idx").isNotNull(), month_label("m_idx")).alias("month"), "level_id", "orders")
