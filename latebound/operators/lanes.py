"""A4, both ends at once: is a region slow because of its sellers, or because of whom they ship to?

Regional averages mix the two: a state whose sellers ship far looks slow. Here
the mean delay of each lane (seller's state to customer's state) is split into
a general mean, an effect of the origin and one of the destination, fitted by
least squares over lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import ratio
from ..session import materialize

ROUND = 4


def lane_table(attributed: DataFrame, sellers: DataFrame, customers: DataFrame, region: str = "state") -> DataFrame:
    """``origin, destination, lines, delay_sum``: delivered lines and their days against the estimate, per lane.

    Lines are reduced to (seller, customer) before the sellers join and to
    (customer, origin) before the customers join. Lines without a region at either end are left out."""
    pairs = (attributed.where(F.col("delivery_delay").isNotNull()).groupBy("seller_id", "customer_id")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("delivery_delay").alias("d")))
    origins = sellers.where(F.col(region).isNotNull()).select("seller_id", F.col(region).alias("origin"))
    destinations = customers.where(F.col(region).isNotNull()).select("customer_id", F.col(region).alias("destination"))
    per_customer = pairs.join(origins, "seller_id").groupBy("customer_id", "origin").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))
    return per_customer.join(destinations, "customer_id").groupBy("origin", "destination").agg(
        F.sum("n").cast("long").alias("lines"), F.sum("d").cast("long").alias("delay_sum"))


def fit_lanes(lanes: DataFrame, tolerance: float = 1e-7, max_rounds: int = 100) -> tuple[DataFrame, DataFrame, float]:
    """Effects ``(origins, destinations, mean)`` of a written lane table: frames ``origin, o`` and ``destination, d``.

    Each round sets every origin's effect to the mean of what its lines have
    left beside the destinations' effects, then the other way round (alternating least
    squares, from zero), and writes both. It ends when no destination's effect moves by more than
    ``tolerance`` days; a fit that has not settled after ``max_rounds`` raises. Origins
    that share no chain of lanes cannot be told from their destinations; such groups keep what the start at
    zero gives them, the origins taking the difference."""
    total = lanes.agg(ratio(F.sum("delay_sum"), F.sum("lines")).alias("m")).first()["m"]
    mean = 0.0 if total is None else total
    left = F.col("delay_sum") - F.col("lines") * F.lit(mean)

    def step(effects: DataFrame, known: str, value: str, side: str, out: str) -> DataFrame:
        rest = lanes.join(effects, known).groupBy(side).agg(
            (F.sum(left - F.col("lines") * F.col(value)) / F.sum("lines")).alias(out))
        return materialize(rest, f"lane_{out}")

    d = materialize(lanes.select("destination").distinct().withColumn("d", F.lit(0.0)), "lane_d")
    for _ in range(max_rounds):
        o = step(d, "destination", "d", "origin", "o")
        new = step(o, "origin", "o", "destination", "d")
        moved = new.join(d.withColumnRenamed("d", "old"), "destination").agg(
            F.max(F.abs(F.col("d") - F.col("old"))).alias("m")).first()["m"]
        d = new
        if moved is None or moved <= tolerance:
            return o, d, mean
    raise RuntimeError(f"lane effects moved by {moved} days in round {max_rounds}")


def lane_effects(lanes: DataFrame, tolerance: float = 1e-7, max_rounds: int = 100) -> DataFrame:
    """One row per end and region: ``side`` (origin, destination), ``region,
    lines, mean_delay`` (of its lines) and ``effect``: the days that the region adds at this end with the
    other end held alike. Effects of a side average zero over lines."""
    lanes = materialize(lanes, "lanes")
    o, d, _ = fit_lanes(lanes, tolerance, max_rounds)

    def side(effects: DataFrame, name: str, value: str) -> DataFrame:
        rows = lanes.groupBy(name).agg(F.sum("lines").cast("long").alias("lines"),
                                       F.round(ratio(F.sum("delay_sum"), F.sum("lines")), ROUND).alias("mean_delay"))
        centre = lanes.join(effects, name).agg((F.sum(F.col(value) * F.col("lines")) / F.sum("lines")).alias("centre"))
        return rows.join(effects, name).crossJoin(centre).select(  # one row
            F.lit(name).alias("side"), F.col(name).alias("region"), "lines", "mean_delay",
            F.round(F.col(value) - F.col("centre"), ROUND).alias("effect"))

    return side(o, "origin", "o").unionByName(side(d, "destination", "d"))


def lane_excess(lanes: DataFrame, min_lines: int = 1, tolerance: float = 1e-7, max_rounds: int = 100) -> DataFrame:
    """One row per lane of at least ``min_lines`` lines: ``origin, destination, lines, mean_delay, expected`` (mean and both effects) and
    ``excess``, what neither end explains: the lane itself is the bottleneck."""
    lanes = materialize(lanes, "lanes")
    o, d, mean = fit_lanes(lanes, tolerance, max_rounds)
    expected = F.lit(mean) + F.col("o") + F.col("d")
    actual = F.col("delay_sum") / F.col("lines")
    return (lanes.where(F.col("lines") >= min_lines).join(o, "origin").join(d, "destination")
            .select("origin", "destination", "lines", F.round(actual, ROUND).alias("mean_delay"),
                    F.round(expected, ROUND).alias("expected"), F.round(actual - expected, ROUND).alias("excess")))
