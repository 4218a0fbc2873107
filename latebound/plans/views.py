"""Temp views for SQL users: the canonical tables and the attributed lines,
so hand-written ``spark.sql`` analyses see the same facts as the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import catalog

VIEWS = ("lines", "seller_month", "seller_profile", "sellers", "customers", "products", "cities")


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Create temp views ``lines`` (attributed line fact), ``seller_month``,
    ``seller_profile`` and the dimensions; return their names."""
    from .. import operators as op

    lines = catalog.attributed_lines(spark, sf_dir)
    frames = {
        "lines": lines,
        "seller_month": op.seller_month(lines),
        "seller_profile": catalog.profile(spark, sf_dir),
        "sellers": catalog.sellers(spark, sf_dir),
        "customers": catalog.customers(spark, sf_dir),
        "products": catalog.products(spark, sf_dir),
        "cities": catalog.cities(spark, sf_dir),
    }
    names = []
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
