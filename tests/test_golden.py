"""Golden numbers of FIXTURES.md §5 (sf0.01 unless stated)."""

import pytest

from conftest import SF001, SF01
from latebound import operators as op
from latebound.plans import catalog


@pytest.fixture(scope="module")
def att(spark):
    return catalog.attributed_lines(spark, SF01)


@pytest.fixture(scope="module")
def prof(att):
    return op.seller_profile(op.seller_month(att))


def test_cause_counts_and_revenue(att):
    got = {r["cause"]: r for r in op.attribution_summary(att).collect()}
    assert {c: r["lines"] for c, r in got.items()} == {
        "on_time": 42604, "absorbed": 4214, "seller": 7381, "carrier": 2797, "unknown": 930, "undelivered": 2074}
    assert {c: r["revenue"] for c, r in got.items()} == {
        "on_time": 2260052090.16, "seller": 392049346.4, "absorbed": 221579113.26,
        "carrier": 148261591.85, "unknown": 50804030.08, "undelivered": 110510099.88}
    assert got["seller"]["seller_days"] + got["carrier"]["seller_days"] == 23848
    assert sum(got[c]["carrier_days"] for c in ("seller", "carrier")) == 8300 + 6044
    assert (got["unknown"]["seller_days"], got["unknown"]["carrier_days"]) == (None, None)


def test_the_fixture_keeps_every_line(spark, att):
    for sf, lines in ((SF001, catalog.attributed_lines(spark, SF001)), (SF01, att)):
        assert lines.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_line_totals(att):
    from pyspark.sql import functions as F

    r = att.agg(F.count("*").alias("n"), F.countDistinct("order_id").alias("o"),
                F.countDistinct("seller_id").alias("s"), F.sum("delivery_delay").alias("d"),
                F.min("dispatch_delay").alias("a"), F.max("dispatch_delay").alias("b")).first()
    assert (r["n"], r["o"], r["s"], r["d"], r["a"], r["b"]) == (60000, 14743, 1372, -258093, -14, 14)


def test_sf0001_counts(spark):
    got = {r["cause"]: r["lines"] for r in op.attribution_summary(catalog.attributed_lines(spark, SF001)).collect()}
    assert got == {"on_time": 4368, "absorbed": 404, "seller": 683, "carrier": 267, "unknown": 89, "undelivered": 189}


def test_tenure_table(prof):
    got = {r["bucket"]: r for r in op.tenure_vs_delay(prof).collect()}
    want = {"1": (208, 732, -2.007, 4.256, 0.3361), "2-6": (364, 4765, -2.103, 4.380, 0.3299),
            "7-12": (202, 6612, -2.218, 4.442, 0.3152), "13+": (598, 45817, -5.062, 3.449, 0.1573)}
    for b, (s, n, a, late, rate) in want.items():
        r = got[b]
        assert (r["sellers"], r["lines"]) == (s, n)
        assert round(r["avg_delay_all"], 3) == a and round(r["avg_delay_late"], 3) == late
        assert round(r["late_rate"], 4) == rate


def test_cohorts_and_retention(att, prof):
    coh = op.first_month_cohorts(prof)
    labels = {r["label"]: r["count"] for r in coh.groupBy("label").count().collect()}
    assert labels == {"excellent": 586, "normal": 445, "severe": 340, "unrated": 1}
    ret = {(r["label"], r["k"]): r for r in op.cohort_retention(op.seller_month(att), coh, 24).collect()}
    assert len(ret) == 100
    for k, v in {1: 0.865, 6: 0.652, 12: 0.544, 20: 0.358}.items():
        assert round(ret[("excellent", k)]["retention"], 3) == v
    for k, v in {1: 0.744, 6: 0.382, 12: 0.209, 20: 0.115}.items():
        assert round(ret[("severe", k)]["retention"], 3) == v
    assert ret[("excellent", 24)]["observable"] == 456
    assert all(ret[(lbl, 0)]["retention"] == 1.0 for lbl in ("excellent", "normal", "severe", "unrated"))
    assert op.new_seller_watchlist(coh).count() == 304


def test_seller_lists(prof):
    assert op.black_sellers_rfm(prof).count() == 28
    assert op.good_seller_badge(prof).count() == 10
    ranking = op.seller_penalty_ranking(prof)
    assert ranking.count() == 1372
    assert ranking.where("adjusted_rank > base_rank").count() == 257


def test_deciles_and_correlation(spark, att):
    products = catalog.fixture.products(spark, SF01)
    dec = sorted((r["decile"], r["members"]) for r in op.seller_blame_deciles(att, products).collect())
    assert [m for _, m in dec] == [129, 129, 129] + [128] * 7
    c = op.spec_delay_correlation(att, products).first()
    assert (c["share_weight"], c["share_volume"], c["weight_dispatch"]) == (0.152168, -0.008538, 0.183732)
    assert op.fulfilment_priority_groups(att, products).count() == 18


def test_regions(spark, att):
    sellers, cities = catalog.fixture.sellers(spark, SF01), catalog.fixture.cities(spark, SF01)
    assert op.regional_bottlenecks(att, sellers, cities).count() == 33
    assert op.unmatched_cities(sellers, cities).count() == 10
