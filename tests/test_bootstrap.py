"""The bootstrap interval of the tenure gap."""

import hashlib
import random
import statistics

import pytest

from latebound import operators as op
from latebound.operators.bootstrap import MIX, STEP, WORD, id_word, poisson_limits, poisson_weight
from pyspark.sql import functions as F

PROFILE = "seller_id {}, tenure int, active_months int, delay_sum long, delivered long, late_delay_sum long, late long"


def weight(ident, replicate):
    x = (int(hashlib.md5(str(ident).encode()).hexdigest()[:8], 16) + replicate * STEP) % WORD
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIX % WORD
    x ^= x >> 16
    return sum(x >= v for v in poisson_limits())


def made(spark, gap=1.7, n=600, kind="long"):
    rnd, rows = random.Random(7), []
    for i in range(n):
        t = rnd.choice([1, 1, 5, 14, 20])
        d = rnd.randint(1, 9)
        delay = sum(rnd.gauss(5 if t == 1 else 5 - gap, 2) for _ in range(d))
        rows.append((f"s{i}" if kind == "string" else i, t, t, round(delay), d, round(max(delay, 0)), d))
    return rows, spark.createDataFrame(rows, PROFILE.format(kind))


def test_weights_equal_the_plain_hash(spark):
    df = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "id long").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(5))))
    for r in df.select("id", "r", poisson_weight(id_word(F.col("id")), F.col("r")).alias("w")).collect():
        assert r["w"] == (weight(r["id"], r["r"]) if r["id"] is not None else r["w"])
    many = [weight(i, r) for i in range(400) for r in range(1, 101)]
    assert abs(statistics.mean(many) - 1) < 0.02 and abs(statistics.variance(many) - 1) < 0.05
    # two repetitions draw independently
    a, b = ([weight(i, r) for i in range(4000)] for r in (1, 2))
    assert abs(statistics.correlation(a, b)) < 0.05


@pytest.mark.parametrize("kind", ["long", "string"])
def test_replicates_equal_a_plain_loop(spark, kind):
    rows, df = made(spark, kind=kind)
    got = {r["replicate"]: r["gap_all"] for r in op.gap_replicates(df, 8).collect()}
    assert sorted(got) == list(range(1, 9))
    for k, gap in got.items():
        one = [(weight(r[0], k), r[3], r[4]) for r in rows if r[1] <= 1]
        long = [(weight(r[0], k), r[3], r[4]) for r in rows if r[1] >= 13]
        rate = lambda rs: sum(w * a for w, a, _ in rs) / sum(w * b for w, _, b in rs)
        assert gap == pytest.approx(rate(one) - rate(long))


def test_interval_holds_the_planted_gap(spark):
    _, df = made(spark)
    r = op.tenure_gap_interval(df).first()
    assert r["gap_all_low"] < 1.7 < r["gap_all_high"] and r["gap_all_high"] - r["gap_all_low"] < 1
    assert 3.2 < (r["gap_all_high"] - r["gap_all_low"]) / r["gap_all_se"] < 4.6
    wide = op.tenure_gap_interval(df, level=0.99).first()
    assert wide["gap_all_low"] < r["gap_all_low"] < r["gap_all_high"] < wide["gap_all_high"]


def test_no_gap_and_bad_options(spark):
    _, df = made(spark)
    r = op.tenure_gap_interval(df.where("tenure = 5")).first()
    assert r["gap_all_low"] is None and r["gap_all_replicates"] == 0
    with pytest.raises(ValueError, match="replicates"):
        op.tenure_gap_interval(df, replicates=1)


def test_repetitions_share_one_aggregate(spark):
    _, df = made(spark)
    plan = op.gap_replicates(df, 50)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") <= 2 and plan.count("Generate") <= 2


def test_weights_are_computed_once_a_row(spark):
    """The hash's rounds are not put into each other (the plan would hold hundreds of copies), nothing is interpreted."""
    _, df = made(spark, n=20)
    plan = op.gap_replicates(df, 50)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "lambda" not in plan and plan.count(str(MIX)) <= 4
