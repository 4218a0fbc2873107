"""Trend, shrunk deciles, matched gap and mergeable order counts against plain computations."""

import random
import statistics
from collections import defaultdict

import pytest

from conftest import SF01
from helpers import frame, line
from latebound import operators as op
from latebound.plans import catalog
from pyspark.sql import functions as F


def monthly(spark, values, gap_at=None):
    rows = []
    for i, v in enumerate(values):
        m = 12 * 2020 + i + (3 if gap_at is not None and i >= gap_at else 0)
        rows.append((f"{m // 12:04d}-{m % 12 + 1:02d}", v, None if v is None else v / 2))
    return rows, spark.createDataFrame(rows, "month string, late_order_share double, late_revenue_share double")


@pytest.mark.parametrize("gap_at", [None, 6])
def test_trend(spark, gap_at):
    rnd = random.Random(3)
    values = [round(0.1 + 0.01 * rnd.randint(0, 5) + (0.2 if i >= 14 else 0), 2) for i in range(24)] + [None]
    rows, df = monthly(spark, values, gap_at)
    r = {x["measure"]: x for x in op.late_revenue_trend(df).collect()}["late_order_share"]
    t = [int(m[:4]) * 12 + int(m[5:]) for m, v, _ in rows if v is not None]
    y = [v for _, v, _ in rows if v is not None]
    pairs = [(y[j] - y[i], t[j] - t[i]) for i in range(24) for j in range(i + 1, 24)]
    s = sum((d > 0) - (d < 0) for d, _ in pairs)
    ties = sum(c * (c - 1) * (2 * c + 5) for c in (y.count(v) for v in set(y)))
    z = (s - (s > 0) + (s < 0)) / ((24 * 23 * 53 - ties) / 18) ** 0.5
    assert (r["months"], r["kendall_s"]) == (24, s) and r["z"] == pytest.approx(z, abs=1e-8)
    assert r["slope"] == pytest.approx(statistics.median(d / k for d, k in pairs), abs=1e-8)
    assert r["change_month"] == rows[14][0] and r["p_value"] < 0.001          # the planted break
    assert r["shift"] == pytest.approx(statistics.mean(y[14:]) - statistics.mean(y[:14]), abs=1e-8)


def test_no_trend(spark):
    r = op.late_revenue_trend(monthly(spark, [0.2] * 12)[1]).first()
    assert (r["kendall_s"], r["z"], r["p_value"], r["slope"]) == (0, None, None, 0.0)
    one = op.late_revenue_trend(monthly(spark, [0.2])[1]).first()
    assert (one["months"], one["kendall_s"], one["slope"], one["change_month"]) == (1, 0, None, None)
    assert op.late_revenue_trend(monthly(spark, [None])[1]).count() == 0


def test_shrunk_deciles_have_fewer_tied_edges(spark):
    att, products = catalog.attributed_lines(spark, SF01), catalog.products(spark, SF01)
    plain = op.seller_blame_deciles(att, products).orderBy("decile").collect()
    tied = sum(a["max_share"] == b["min_share"] for a, b in zip(plain, plain[1:]))
    shrunk = op.seller_blame_deciles_shrunk(att, products).orderBy("decile").collect()
    assert sum(r["tied_below"] for r in shrunk) < tied
    assert [r["members"] for r in shrunk] == [r["members"] for r in plain]
    assert sum(r["late_lines"] for r in shrunk) == sum(r["late_lines"] for r in plain)


def test_shrinkage(spark):
    rows = [(i, late, k, k / late) for i, (late, k) in enumerate([(1, 1), (50, 50), (1, 0), (50, 0), (20, 10), (2, 1)])]
    df = spark.createDataFrame(rows, "seller_id int, late long, seller_late long, blame_share double")
    got = {r["seller_id"]: r for r in op.shrunk_shares(df).collect()}
    n, g = sum(r[1] for r in rows), len(rows)
    mean = sum(r[2] for r in rows) / n
    spread = sum(r[1] * (r[3] - mean) ** 2 for r in rows)
    rho = (spread - mean * (1 - mean) * (g - 1)) / (mean * (1 - mean) * (n - sum(r[1] ** 2 for r in rows) / n - (g - 1)))
    k = 1 / min(0.999, max(1e-4, rho)) - 1
    for i, late, own, _ in rows:
        assert got[i]["posterior"] == pytest.approx((own + k * mean) / (late + k), abs=1e-4)
    assert got[3]["posterior"] < got[2]["posterior"] < mean < got[0]["posterior"] < got[1]["posterior"]


def placed(spark, kind):
    rnd = random.Random(8)
    lines = [line(rnd.randint(1, 300) * (1 if kind == "long" else 1), rnd.randint(1, 9), line_no=i, month=rnd.randint(0, 3)) for i in range(800)]
    lines += [line(10**12 + 5, 1, line_no=900), line(-7, 2, line_no=901)]
    df = op.delay_attribution(op.enrich(frame(spark, lines)))
    if kind == "string":
        df = df.withColumn("order_id", F.concat(F.lit("o"), F.col("order_id")))
    sellers = spark.createDataFrame([(s, "x", "AB"[s % 2]) for s in range(1, 9)], "seller_id long, city_raw string, state string")
    return lines, df, sellers


@pytest.mark.parametrize("kind", ["long", "string"])
def test_orders_add_up_over_regions(spark, kind):
    lines, df, sellers = placed(spark, kind)
    want = defaultdict(set)
    for order, _, _, seller, _, ordered, *_ in lines:
        state = "AB"[seller % 2] if seller < 9 else None
        for key in ((state, ordered.strftime("%Y-%m"), 0), (state, None, 1), (None, None, 3)):
            want[key].add(order)
    got = {(r["state"], r["month"], r["level_id"]): r["orders"] for r in op.orders_by_region(df, sellers).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_no_exchange_by_order(spark):
    _, df, sellers = placed(spark, "long")
    plan = op.orders_by_region(df, sellers)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert exchanges and not any("order_id" in x.split("hashpartitioning(")[1].split(")")[0] for x in exchanges)


def test_matched_gap(spark):
    profile = spark.createDataFrame(
        # seller, tenure, active months, revenue, delivered, delay, late, late delay
        [(1, 1, 1, 50.0, 2, 10, 1, 8), (2, 14, 14, 700.0, 4, 8, 2, 6), (3, 20, 20, 900.0, 6, 6, 0, 0),
         (4, 1, 1, 5000.0, 1, 9, 1, 9), (5, 13, 13, 650.0, 1, 2, 1, 2), (6, 5, 5, 60.0, 1, 1, 1, 1), (7, 1, 1, 60.0, 2, 0, 0, 0)],
        "seller_id long, tenure int, active_months int, revenue double, delivered long, delay_sum long, late long, late_delay_sum long")
    cats = spark.createDataFrame([(i, "c") for i in (1, 2, 3, 4, 6, 7)] + [(5, "d")], "seller_id long, category string")
    sellers = spark.createDataFrame([(i, "x", "A") for i in range(1, 8)], "seller_id long, city_raw string, state string")
    r = op.tenure_gap_matched(profile, cats, sellers).first()
    assert (r["strata"], r["unmatched_strata"], r["one_off"], r["long"]) == (1, 2, 2, 2)
    assert r["gap_all"] == pytest.approx(10 / 4 - 14 / 10) and r["gap_late"] == pytest.approx(8 / 1 - 6 / 2)
    assert r["unmatched_one_off"] == pytest.approx(1 / 3) and r["unmatched_long"] == pytest.approx(1 / 3)
    none = op.tenure_gap_matched(profile.limit(0), cats, sellers).first()
    assert none["strata"] == 0 and none["gap_all"] is None


def test_main_category(spark):
    att = op.delay_attribution(op.enrich(frame(spark, [line(i, 1, line_no=i, product_id=p) for i, p in enumerate([1, 1, 2, 3, 3, 9])])))
    products = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "product_id long, category string")
    assert [tuple(r) for r in op.main_category(att, products).collect()] == [(1, "a")]
