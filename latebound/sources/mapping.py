"""From a user's orders and order items to the canonical line fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLUMNS = ("order_id", "customer_id", "ordered_at", "shipped_at", "delivered_at", "estimated_at")
ITEM_COLUMNS = ("order_id", "line_no", "product_id", "seller_id", "ship_limit_at", "price")
TIMES = ("ordered_at", "shipped_at", "delivered_at", "estimated_at", "ship_limit_at")


def read_text_table(spark: SparkSession, path: str, columns: list[str], fmt: str = "csv") -> DataFrame:
    """A CSV (with header) or Parquet table with declared columns. CSV columns are read as text; the mapper casts."""
    if fmt == "csv":
        schema = ", ".join(f"`{c}` string" for c in columns)
        return spark.read.schema(schema).option("header", "true").csv(path)
    return spark.read.parquet(path).select(*columns)


def _typed(name: str, source: str) -> Column:
    c = F.col(source)
    if name in TIMES:
        c = F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")
    elif name == "price":
        c = c.cast("decimal(12,2)")
    return c.alias(name)


def map_lines(orders: DataFrame, items: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The canonical ``fulfilment_lines``: items joined with their orders.

    ``columns`` names the source column of a canonical one where they differ
    (``{"ordered_at": "purchase_time"}``); ``order_id`` holds for both tables,
    or give ``order_id`` for the orders and ``item_order_id`` for the items.
    Ids keep their type, text included; times that cannot be read are NULL.
    An equi-join that Spark plans by the tables' sizes; items without an order
    go, as they have no order date.
    """
    named = dict(columns or {})
    item_order = named.pop("item_order_id", named.get("order_id", "order_id"))
    o = orders.select(*[_typed(c, named.get(c, c)) for c in ORDER_COLUMNS])
    i = items.select(*[_typed(c, item_order if c == "order_id" else named.get(c, c)) for c in ITEM_COLUMNS])
    return i.join(o, "order_id").select(
        "order_id", "line_no", "product_id", "seller_id", "customer_id", "ordered_at", "ship_limit_at", "shipped_at",
        "delivered_at", "estimated_at", "price")
