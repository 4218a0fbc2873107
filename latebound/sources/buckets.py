"""Orders and items in buckets of the order id: the join that every fact starts with, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mapping import map_lines


def write_buckets(orders: DataFrame, items: DataFrame, name: str, buckets: int, columns: dict[str, str] | None = None,
                  path: str | None = None) -> None:
    """Save the tables ``<name>_orders`` and ``<name>_items``, both cut into ``buckets`` by their order id and sorted by it.

    They are tables of the session's catalog, in its warehouse, or under ``path``
    if given (a folder that all executors share). Rows are shuffled once, here, so that a bucket is one file;
    later joins read bucket with bucket. ``columns`` is that of :func:`map_lines`. Buckets of about 1 GB suit a
    large table; order ids hash evenly, as an order has few items. Both tables need the same number, and ids of one type."""
    named = dict(columns or {})
    key = named.get("order_id", "order_id")
    for table, df, col in (("orders", orders, key), ("items", items, named.get("item_order_id", key))):
        if df.schema[col].dataType != orders.schema[key].dataType:
            raise TypeError(f"order ids differ in type: {orders.schema[key].dataType}, {df.schema[col].dataType}")
        writer = (df.repartition(buckets, col).write.mode("overwrite").format("parquet").bucketBy(buckets, col).sortBy(col))
        if path is not None:
            writer = writer.option("path", f"{path.rstrip('/')}/{name}_{table}")
        writer.saveAsTable(f"{name}_{table}")


def map_buckets(spark: SparkSession, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """:func:`map_lines` of the tables that :func:`write_buckets` saved: a sort-merge join of
    buckets, no exchange on either side; each task sorts its bucket's rows, which lie sorted already. (Spark may still broadcast a small orders table, which moves less.)"""
    return map_lines(spark.table(f"{name}_orders"), spark.table(f"{name}_items"), columns)
