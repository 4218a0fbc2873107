"""Canonical tables every operator consumes.

Callers map their own source columns onto these names (for a marketplace
export, order items joined to orders give ``fulfilment_lines``). ``validate`` checks
names and type families at the entry of each operator, so a wrong mapping
fails fast instead of producing NULL rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ID_TYPES = (T.LongType, T.IntegerType, T.StringType)
TS_TYPES = (T.TimestampType, T.TimestampNTZType)
NUM_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.DecimalType,
             T.ShortType)

# Sums of money are exact in cents.
MONEY = ("price",)

# One row per order line. The order date, the seller's shipping deadline,
# the hand-over to the carrier, the delivery and the promised date.
FULFILMENT_LINES = {
    "order_id": ID_TYPES,
    "line_no": ID_TYPES,
    "product_id": ID_TYPES,
    "seller_id": ID_TYPES,
    "customer_id": ID_TYPES,
    "ordered_at": TS_TYPES,
    "ship_limit_at": TS_TYPES,
    "shipped_at": TS_TYPES,
    "delivered_at": TS_TYPES,
    "estimated_at": TS_TYPES,
    "price": (T.DecimalType,),
}

SELLERS = {"seller_id": ID_TYPES, "city_raw": (T.StringType,), "state": (T.StringType,)}
CUSTOMERS = {"customer_id": ID_TYPES, "city_raw": (T.StringType,), "state": (T.StringType,)}
PRODUCTS = {
    "product_id": ID_TYPES,
    "category": (T.StringType,),
    "weight": NUM_TYPES,
    "length": NUM_TYPES,
    "width": NUM_TYPES,
    "height": NUM_TYPES,
}
CITIES = {"city_key": (T.StringType,), "city": (T.StringType,), "state": (T.StringType,)}

FULFILMENT_LINES_STRUCT = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("line_no", T.IntegerType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("seller_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("ordered_at", T.TimestampNTZType(), False),
    T.StructField("ship_limit_at", T.TimestampNTZType(), True),
    T.StructField("shipped_at", T.TimestampNTZType(), True),
    T.StructField("delivered_at", T.TimestampNTZType(), True),
    T.StructField("estimated_at", T.TimestampNTZType(), True),
    T.StructField("price", T.DecimalType(12, 2), False),
])


def validate(df: DataFrame, spec: dict, name: str) -> DataFrame:
    """Raise if a required column is missing or of the wrong type family."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for col, allowed in spec.items():
        if col not in fields:
            problems.append(f"missing column {col!r}")
        elif not isinstance(fields[col], allowed):
            problems.append(f"{col!r} is {fields[col].simpleString()}")
        elif col in MONEY and fields[col].scale > 2:
            problems.append(f"{col!r} is {fields[col].simpleString()}: money has two decimals at most")
    if problems:
        raise ValueError(f"{name}: " + "; ".join(problems))
    return df
