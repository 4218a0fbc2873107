"""One hand-made case for each answer that was once wrong, and the CSV way in."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import frame, line
from latebound import operators as op
from latebound.functions.city import city_key
from latebound.operators.tenure import tenure_bucket
from latebound.schema import FULFILMENT_LINES, validate
from latebound.sources import map_lines, read_text_table

PRODUCT = "product_id long, category string, weight {w}, length {s}, width {s}, height {s}"


def products(spark, rows, w="double", s="double"):
    return spark.createDataFrame(rows, PRODUCT.format(w=w, s=s))


def late_lines(spark):
    return op.delay_attribution(op.enrich(frame(spark, [line(1, 5, ship=8, deliver=20)])))


def test_fractional_sizes(spark):
    got = op.blame_by_grain(late_lines(spark), products(spark, [(1, "a", 0.75, 1.5, 1.5, 0.5)])).first()
    assert (got["avg_weight"], got["avg_volume"]) == (0.75, 1.125)


def test_large_integer_sizes(spark):
    specs = products(spark, [(1, "a", 1, 2000, 2000, 2000)], "int", "int")
    assert op.blame_by_grain(late_lines(spark), specs).first()["avg_volume"] == 8e9
    groups = op.fulfilment_priority_groups(late_lines(spark), specs, bulk_volume=7.9e9).collect()
    assert [g["size_band"] for g in groups] == ["bulky"]


def test_volume_alone_makes_bulky(spark):
    rows = [(1, "a", None, 100.0, 100.0, 100.0), (2, "a", None, 1.0, 1.0, 1.0), (3, "a", None, None, 1.0, 1.0)]
    lines = op.delay_attribution(op.enrich(frame(spark, [line(i, 5, product_id=i) for i in (1, 2, 3)])))
    got = {r["size_band"] for r in op.fulfilment_priority_groups(lines, products(spark, rows), bulk_volume=1000).collect()}
    assert got == {"bulky", "regular", "unknown"}


def test_unknown_dispatch_charges_nobody(spark):
    got = op.delay_attribution(op.enrich(frame(spark, [line(1, 5, no_limit=True, deliver=20)]))).first()
    assert (got["cause"], got["seller_days"], got["carrier_days"]) == ("unknown", None, None)


def test_ambiguous_city_gives_one_row(spark):
    cities = spark.createDataFrame([("springfield", "Springfield", "A"), ("springfield", "Springfield", "B"),
                                    ("shelby", "Shelby", "A")], "city_key string, city string, state string")
    sellers = spark.createDataFrame([(1, "Springfield"), (2, "Shelby")], "seller_id long, city_raw string")
    got = {r["seller_id"]: r["city"] for r in op.city_cleanse(sellers, cities, state_col=None).collect()}
    assert got == {1: None, 2: "Shelby"}
    assert op.city_cleanse(sellers, cities, state_col=None).count() == 2
    assert op.unmatched_cities(sellers, cities, state_col=None).count() == 0


@pytest.mark.parametrize(("raw", "state", "key"), [
    ("lages - sc", "SC", "lages"), ("São Paulo", "SP", "sao paulo"),
    ("rio de janeiro \\rio de janeiro", "RJ", "rio de janeiro"), ("sc", "SC", "sc"), ("Porto", None, "porto"),
    (None, "SC", None), ("///", "SC", None)])
def test_city_forms(spark, raw, state, key):
    df = spark.createDataFrame([(raw, state)], "raw string, state string")
    assert df.select(city_key("raw", F.col("state")).alias("k")).first()["k"] == key


def test_growth_needs_the_month_before(spark):
    lines = op.delay_attribution(op.enrich(frame(spark, [line(1, 5, month=0), line(2, 5, month=3), line(3, 5, month=4)])))
    got = [r["revenue_growth"] for r in op.late_revenue_monthly(lines).orderBy("month").collect()]
    assert got == [None, None, 0.0]


def test_money_has_two_decimals(spark):
    df = frame(spark, [line(1, 5)]).withColumn("price", F.lit(Decimal("10.9999")).cast("decimal(12,4)"))
    with pytest.raises(ValueError, match="two decimals"):
        validate(df, FULFILMENT_LINES, "lines")


@pytest.mark.parametrize(("long_months", "want"), [
    (6, ["1", "2-5", "2-5", "6+", "6+"]), (13, ["1", "2-6", "2-6", "2-6", "13+"]), (1, ["1+"] * 5)])
def test_bucket_edges(spark, long_months, want):
    df = spark.createDataFrame([(t,) for t in (1, 2, 5, 6, 13)], "t int").orderBy("t")
    assert [r[0] for r in df.select(tenure_bucket(F.col("t"), long_months)).collect()] == want


def test_dimensions_are_validated(spark):
    bad = spark.createDataFrame([(1, "a")], "product_id long, category string")
    with pytest.raises(ValueError, match="products"):
        op.blame_by_grain(late_lines(spark), bad)


def test_retention_plan(spark):
    """Retention does not count distinct orders and reads the seller-months twice at most."""
    from conftest import SF001
    from latebound.plans import QUERIES

    df = QUERIES["cohort_retention"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "order_id" not in plan and plan.count("/seller_month-") <= 2


def test_two_csv_files_with_text_ids(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "oid,buyer,bought,handed,arrived,promised\n"
        "o1,c1,2020-01-10 08:00:00,2020-01-20 08:00:00,2020-02-01 08:00:00,2020-01-25 00:00:00\n"
        "o2,c2,2020-02-10 08:00:00,2020-02-11 08:00:00,2020-02-15 08:00:00,2020-02-25 00:00:00\n"
        "o3,c1,2020-02-11 08:00:00,,not yet,2020-02-25 00:00:00\n")
    (tmp_path / "items.csv").write_text(
        "order,n,item,shop,limit,amount\n"
        "o1,1,p1,s1,2020-01-15 00:00:00,10.50\no1,2,p2,s2,2020-01-25 00:00:00,5.00\n"
        "o2,1,p1,s1,2020-02-15 00:00:00,7.25\no3,1,p1,s2,2020-02-15 00:00:00,1.00\n")
    orders = read_text_table(spark, str(tmp_path / "orders.csv"), ["oid", "buyer", "bought", "handed", "arrived", "promised"])
    items = read_text_table(spark, str(tmp_path / "items.csv"), ["order", "n", "item", "shop", "limit", "amount"])
    lines = map_lines(orders, items, {
        "order_id": "oid", "item_order_id": "order", "customer_id": "buyer", "ordered_at": "bought",
        "shipped_at": "handed", "delivered_at": "arrived", "estimated_at": "promised", "line_no": "n",
        "product_id": "item", "seller_id": "shop", "ship_limit_at": "limit", "price": "amount"})
    att = op.delay_attribution(op.enrich(lines))
    assert {(r["order_id"], r["seller_id"]): r["cause"] for r in att.collect()} == {
        ("o1", "s1"): "seller", ("o1", "s2"): "carrier", ("o2", "s1"): "on_time", ("o3", "s2"): "undelivered"}
    sm = op.seller_month(att)
    prof = op.seller_profile(sm)
    scores = {r["seller_id"]: r["monetary"] for r in op.rfm_scores(prof).collect()}
    assert scores == {"s1": 17.75, "s2": 6.0}
    coh = op.first_month_cohorts(prof)
    assert {r["seller_id"]: r["label"] for r in coh.collect()} == {"s1": "severe", "s2": "severe"}
    ret = {(r["label"], r["k"]): r["active"] for r in op.cohort_retention(sm, coh, 1).collect()}
    assert ret == {("severe", 0): 2, ("severe", 1): 2}
    sellers = spark.createDataFrame([("s1", "lages - sc", "SC"), ("s2", "nowhere", "SC")],
                                    "seller_id string, city_raw string, state string")
    cities = spark.createDataFrame([("lages", "Lages", "SC")], "city_key string, city string, state string")
    got = {r["city"]: r["seller_late"] for r in op.regional_bottlenecks(att, sellers, cities).collect()}
    assert got == {"Lages": 1, None: 0}
