"""Hand-made canonical rows for edge-case tests."""

from datetime import datetime, timedelta
from decimal import Decimal

from latebound.schema import FULFILMENT_LINES_STRUCT

BASE = datetime(2020, 1, 10)


def line(order_id, seller_id, *, line_no=1, product_id=1, customer_id=1, month=0, limit=5,
         ship=3, deliver=10, estimate=12, price="10.00", no_limit=False, day=0):
    """One canonical line. Day offsets are relative to the order date;
    ``deliver=None`` means undelivered."""
    ordered = datetime(BASE.year + (BASE.month - 1 + month) // 12, (BASE.month - 1 + month) % 12 + 1,
                       10) + timedelta(days=day)
    d = lambda n: None if n is None else ordered + timedelta(days=n)
    return (order_id, line_no, product_id, seller_id, customer_id, ordered,
            None if no_limit else d(limit), d(ship), d(deliver), d(estimate), Decimal(price))


def frame(spark, lines):
    return spark.createDataFrame(lines, FULFILMENT_LINES_STRUCT)
