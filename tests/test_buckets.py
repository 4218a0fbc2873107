"""The order-line join over bucketed tables moves no row and gives the same lines."""

import re
import uuid
from datetime import datetime, timedelta

import pytest

from conftest import rows
from latebound import operators as op
from latebound.sources import map_buckets, map_lines, write_buckets

ORDERS = "oid long, customer_id long, bought timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz, estimated_at timestamp_ntz"
ITEMS = "order_ref long, line_no int, product_id long, seller_id long, ship_limit_at timestamp_ntz, price string"
COLUMNS = {"order_id": "oid", "item_order_id": "order_ref", "ordered_at": "bought"}


@pytest.fixture
def tables(spark, tmp_path):
    day = lambda n: datetime(2020, 1, 1) + timedelta(days=n)
    orders = spark.createDataFrame([(i, i % 7, day(i), day(i + 2), day(i + 9 - i % 5), day(i + 7)) for i in range(200)], ORDERS)
    # a third of the items is one seller's; order 3 has many items; orders 190 and on have none; item orders from 500 are unknown
    items = spark.createDataFrame(
        [(i % 190, k, k, 1 if i % 3 == 0 else i % 11, day(i % 190 + 3), f"{i}.50") for i in range(190) for k in (1, 2)]
        + [(3, k, k, 1, day(6), "1.00") for k in range(3, 90)] + [(500 + k, 1, 1, 1, day(1), "1.00") for k in range(5)], ITEMS)
    name = f"b{uuid.uuid4().hex}"
    write_buckets(orders, items, name, 4, COLUMNS, path=str(tmp_path))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield orders, items, name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    spark.sql(f"DROP TABLE {name}_orders")
    spark.sql(f"DROP TABLE {name}_items")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_below_the_join(spark, tables):
    orders, items, name = tables
    joined = map_buckets(spark, name, COLUMNS)
    plan = final_plan(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" in final_plan(map_lines(orders, items, COLUMNS))
    assert rows(joined) == rows(map_lines(orders, items, COLUMNS)) and joined.count() == 190 * 2 + 87


def test_analysis_on_buckets(spark, tables):
    """Only the analysis's own aggregate is exchanged; an aggregate by order needs none at all."""
    orders, items, name = tables

    def att(lines):
        return op.delay_attribution(op.enrich(lines))

    a, b = op.attribution_summary(att(map_buckets(spark, name, COLUMNS))), op.attribution_summary(att(map_lines(orders, items, COLUMNS)))
    assert rows(a) == rows(b)
    plan = final_plan(att(map_buckets(spark, name, COLUMNS)).groupBy("order_id").count())
    assert not re.search(r"Exchange hashpartitioning", plan)


def test_ids_of_two_types(spark, tables):
    orders, items, name = tables
    with pytest.raises(TypeError):
        write_buckets(orders, items.withColumn("order_ref", items["order_ref"].cast("string")), name + "x", 4, COLUMNS)
