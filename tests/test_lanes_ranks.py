"""Rank correlation against all pairs, lane effects against planted ones."""

import random

import pytest

from latebound import operators as op
from pyspark.sql import functions as F

SCHEMA = "id long, x double, y double"


def plain(rows):
    rows = [(x, y) for _, x, y in rows if x is not None and y is not None]
    n = len(rows)
    sign = lambda v: (v > 0) - (v < 0)
    signs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    less, more = sum(a * b < 0 for a, b in signs), sum(a * b > 0 for a, b in signs)
    scale = (sum(a != 0 for a, _ in signs) * sum(b != 0 for _, b in signs)) ** 0.5

    def middles(v):
        return [sum(b < a for b in v) + (v.count(a) + 1) / 2 for a in v]

    rx, ry = middles([r[0] for r in rows]), middles([r[1] for r in rows])
    mx, my = sum(rx) / n, sum(ry) / n
    spread = (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
    rho = sum((a - mx) * (b - my) for a, b in zip(rx, ry)) / spread if spread else None
    return n, less, rho, (more - less) / scale if scale else None


@pytest.mark.parametrize("values,hot", [(5, 0), (40, 0), (1000, 0), (12, 150)])
def test_rank_correlation_with_ties(spark, values, hot):
    rnd = random.Random(values)
    rows = [(i, float(rnd.randint(0, values)) if i >= hot else 1.0, float(rnd.randint(0, values))) for i in range(300)]
    rows += [(900, None, 1.0), (901, 2.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    # small ranges and blocks: pairs inside blocks and across them
    out = {r["pair"]: r for r in op.rank_correlation(df, {"a": ("x", "y"), "b": ("y", "x"), "c": ("x", "x")}, "id",
                                                     rows_per_range=61, block_bits=4).collect()}
    n, less, rho, tau = plain(rows)
    for name in "ab":
        assert (out[name]["rows"], out[name]["discordant"]) == (n, less)
        assert out[name]["spearman"] == pytest.approx(rho, abs=1e-6) and out[name]["kendall"] == pytest.approx(tau, abs=1e-6)
    assert (out["c"]["discordant"], out["c"]["spearman"], out["c"]["kendall"]) == (0, 1.0, 1.0)


def test_rank_correlation_edges(spark):
    pairs = {"a": ("x", "y")}
    one = op.rank_correlation(spark.createDataFrame([(1, 2.0, 3.0)], SCHEMA), pairs, "id").first()
    assert (one["rows"], one["discordant"], one["spearman"], one["kendall"]) == (1, 0, None, None)
    flat = op.rank_correlation(spark.createDataFrame([(i, 2.0, float(i)) for i in range(9)], SCHEMA), pairs, "id").first()
    assert (flat["discordant"], flat["spearman"], flat["kendall"]) == (0, None, None)
    down = op.rank_correlation(spark.createDataFrame([(i, float(i), float(-i)) for i in range(9)], SCHEMA), pairs, "id").first()
    assert (down["discordant"], down["spearman"], down["kendall"]) == (36, -1.0, -1.0)
    assert op.rank_correlation(spark.createDataFrame([], SCHEMA), pairs, "id").count() == 0


def lanes(spark, rows):
    return spark.createDataFrame(rows, "origin string, destination string, lines long, delay_sum long")


def test_planted_lane_effects(spark):
    """Sellers of A ship mostly to the slow X: A looks slow, but adds nothing itself; the lane B-Y is slow alone."""
    o, d = {"A": 0, "B": 2, "C": -2}, {"X": 10, "Y": -4, "Z": 0}
    n = {("A", "X"): 900, ("A", "Y"): 50, ("A", "Z"): 50, ("B", "X"): 50, ("B", "Y"): 900, ("B", "Z"): 50,
         ("C", "X"): 300, ("C", "Y"): 300, ("C", "Z"): 400}
    rows = [(a, b, k, k * (20 + o[a] + d[b])) for (a, b), k in n.items()]
    got = {(r["side"], r["region"]): r for r in op.lane_effects(lanes(spark, rows)).collect()}
    total = sum(n.values())
    for side, effects, at in (("origin", o, 0), ("destination", d, 1)):
        centre = sum(k * effects[key[at]] for key, k in n.items()) / total
        for region, e in effects.items():
            r = got[side, region]
            assert r["effect"] == pytest.approx(e - centre, abs=1e-3)
            assert r["lines"] == sum(k for key, k in n.items() if key[at] == region)
    assert got["origin", "A"]["mean_delay"] > got["origin", "B"]["mean_delay"]
    assert got["origin", "A"]["effect"] < got["origin", "B"]["effect"]
    assert all(abs(r["excess"]) < 1e-3 for r in op.lane_excess(lanes(spark, rows)).collect())
    slow = [(a, b, k, s + (8 * k if (a, b) == ("C", "Z") else 0)) for a, b, k, s in rows]
    worst = max(op.lane_excess(lanes(spark, slow), min_lines=51).collect(), key=lambda r: r["excess"])
    assert (worst["origin"], worst["destination"]) == ("C", "Z") and worst["lines"] == 400


def test_lane_edges(spark):
    assert op.lane_effects(lanes(spark, [])).count() == 0
    one = op.lane_effects(lanes(spark, [("A", "X", 4, 12)])).collect()
    assert {(r["side"], r["mean_delay"], r["effect"]) for r in one} == {("origin", 3.0, 0.0), ("destination", 3.0, 0.0)}
    with pytest.raises(RuntimeError):
        op.lane_effects(lanes(spark, [("A", "X", 9, 90), ("A", "Y", 1, 3), ("B", "Y", 9, 9), ("B", "X", 1, 7)]), max_rounds=1)


def test_lanes_leave_out_lines_without_a_region(spark):
    att = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (2, 1, None), (9, 1, 7), (1, 1, 1)],
                                "seller_id long, customer_id long, delivery_delay int")
    s = spark.createDataFrame([(1, "S"), (2, "T"), (9, None)], "seller_id long, state string")
    c = spark.createDataFrame([(1, "U"), (2, "V")], "customer_id long, state string")
    got = {tuple(r) for r in op.lane_table(att, s, c).collect()}
    assert got == {("S", "U", 2, 4), ("S", "V", 1, 5)}
    assert op.lane_table(att, s, c).agg(F.sum("lines")).first()[0] == 3


def test_correlation_of_a_constant_is_null(spark):
    from latebound.functions.rates import correlation

    def of(rows):
        return spark.createDataFrame(rows, SCHEMA).agg(correlation("x", "y").alias("r"), correlation("y", "x").alias("s")).first()

    assert tuple(of([(1, 2.0, 3.0)])) == tuple(of([(i, 2.0, float(i)) for i in range(5)])) == tuple(of([])) == (None, None)
    rows = [(i, float(i * i), float(7 - i)) for i in range(6)] + [(8, None, 900.0), (9, 900.0, None)]
    r = of(rows)
    expected = spark.createDataFrame(rows, SCHEMA).agg(F.corr("x", "y")).first()[0]
    assert r["r"] == pytest.approx(expected, abs=1e-12) and r["s"] == pytest.approx(expected, abs=1e-12)
