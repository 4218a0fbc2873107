"""Product-limit survival and the log-rank test against a plain computation."""

import math
import random

import pytest

from latebound import operators as op
from latebound.operators.survival import normal_tail
from pyspark.sql import functions as F


def made(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        first = rnd.randint(0, 20)
        label = rnd.choice(["excellent", "severe", "normal"])
        life = rnd.randint(0, 30 if label == "excellent" else 12)
        rows.append((i, first, min(30, first + life), label))
    profile = spark.createDataFrame([r[:3] for r in rows], "seller_id int, first_m int, last_m int")
    return rows, profile, spark.createDataFrame([(r[0], r[3]) for r in rows], "seller_id int, label string")


def lives(rows, grace):
    end = max(r[2] for r in rows)
    return [(label, last - first, end - last >= grace) for _, first, last, label in rows]


@pytest.mark.parametrize("grace", [1, 3, 100])
def test_survival(spark, grace):
    rows, profile, cohorts = made(spark)
    got = {(r["label"], r["k"]): r for r in op.cohort_survival(profile, cohorts, grace).collect()}
    people = lives(rows, grace)
    for label in ("excellent", "severe", "normal"):
        mine = [(k, s) for name, k, s in people if name == label]
        s, green = 1.0, 0.0
        for k in sorted({k for k, _ in mine}):
            n = sum(x >= k for x, _ in mine)
            d = sum(x == k and stop for x, stop in mine)
            s *= 1 - d / n
            r = got.pop((label, k))
            assert (r["at_risk"], r["stopped"], r["censored"]) == (n, d, sum(x == k for x, _ in mine) - d)
            assert r["survival"] == pytest.approx(s, abs=2e-9)
            if s > 0:
                green += d / (n * (n - d))
                assert r["std_err"] == pytest.approx(s * math.sqrt(green), abs=2e-9)
                assert r["low"] == pytest.approx(max(0, s - 1.96 * s * math.sqrt(green)), abs=2e-9)
            else:
                assert r["std_err"] is None
    assert not got
    assert grace < 100 or all(r["survival"] == 1 for r in op.cohort_survival(profile, cohorts, grace).collect())


def test_logrank(spark):
    rows, profile, cohorts = made(spark)
    people = [p for p in lives(rows, 3) if p[0] != "normal"]
    o, e, v = 0, 0.0, 0.0
    for t in sorted({k for _, k, _ in people}):
        at = [(name, k, s) for name, k, s in people if k >= t]
        n, n1 = len(at), sum(name == "excellent" for name, _, _ in at)
        d = sum(k == t and s for _, k, s in at)
        o += sum(k == t and s and name == "excellent" for name, k, s in at)
        e += d * n1 / n
        v += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    r = op.cohort_logrank(profile, cohorts).first()
    assert r["first_stopped"] == o and r["first_expected"] == pytest.approx(e, abs=1e-6)
    assert r["variance"] == pytest.approx(v, abs=1e-6) and r["chi_square"] == pytest.approx((o - e) ** 2 / v, abs=1e-5)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt((o - e) ** 2 / v / 2)), abs=1e-6) and r["p_value"] < 0.01


def test_same_pace_and_one_label(spark):
    _, profile, cohorts = made(spark)
    same = cohorts.withColumn("label", F.when(F.col("seller_id") % 2 == 0, "excellent").otherwise("severe"))
    assert op.cohort_logrank(profile, same).first()["p_value"] > 0.01
    one = op.cohort_logrank(profile, cohorts.where("label = 'severe'")).first()
    assert one["first_stopped"] == 0 and one["variance"] == 0 and one["chi_square"] is None and one["p_value"] is None
    assert op.cohort_survival(profile.limit(0), cohorts.limit(0)).count() == 0


def test_tail(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.0, 6.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(normal_tail(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], abs=3e-7)
