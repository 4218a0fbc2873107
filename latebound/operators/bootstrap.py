"""A7: an interval for the tenure gap, by a Poisson bootstrap of the sellers.

Sellers, not lines, are drawn anew: lines of one seller are alike. In each of
``replicates`` repetitions a seller gets a weight, Poisson with mean 1, from a hash of
its id and the repetition, so reruns and other engines draw the same. A seller's rows of
all repetitions are made from its row of the profile and added up at once
(partial sums before the shuffle: a row per repetition and task); no repetition reads the lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import ratio
from .tenure import _tenure

ROUND = 9
WORD = 1 << 32
#: Odd multipliers of the hash's rounds (below 2^31, so that products fit 64 bits).
MIX = 0x45D9F3B
STEP = 0x9E3779B


def poisson_limits(top: int = 12) -> list[int]:
    """A number drawn from 0..2^32-1 gives as many as it reaches of these limits."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(top):
        total += p
        out.append(int(total * WORD))
        p /= k + 1
    return out


def id_word(ident: Column) -> Column:
    """32 bits of an id of any type."""
    return F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def turned(x: Column) -> Column:
    """A round of the hash. It names ``x`` twice, so rounds put into each other double: large tables take a column a round."""
    return (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX)).bitwiseAND(F.lit(WORD - 1))


def started(word: Column, replicate: Column) -> Column:
    return (word + replicate.cast("long") * F.lit(STEP)).bitwiseAND(F.lit(WORD - 1))


def folded(x: Column) -> Column:
    return F.shiftright(x, 16).bitwiseXOR(x)


def weight_of(drawn: Column) -> Column:
    """The weight of a drawn word. Plain comparisons are compiled; a fold over an array of limits is interpreted."""
    return sum(((drawn >= F.lit(v).cast("long")).cast("int") for v in poisson_limits()), F.lit(0)).cast("long")


def poisson_weight(word: Column, replicate: Column) -> Column:
    """The weight of an id (:func:`id_word`) in a repetition."""
    return weight_of(folded(turned(turned(started(word, replicate)))))


def gap_replicates(profile: DataFrame, replicates: int = 200, long_months: int = 13, basis: str = "span") -> DataFrame:
    """``replicate, gap_all, gap_late`` for each repetition, from 1."""
    t = _tenure(basis)
    sums = ("delay_sum", "delivered", "late_delay_sum", "late")
    ends = profile.where((t <= 1) | (t >= long_months)).select(
        id_word(F.col("seller_id")).alias("word"), (t <= 1).alias("one"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in sums])
    rows = ends.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # poisson_weight, a column a round. Weights of 0 stay: a filter on them would be computed a second time, below.
    rows = rows.withColumn("x", started(F.col("word"), F.col("replicate")))
    for _ in range(2):
        rows = rows.withColumn("x", turned(F.col("x")))
    rows = rows.withColumn("x", folded(F.col("x")))
    rows = rows.withColumn("w", weight_of(F.col("x")))
    totals = rows.groupBy("replicate").agg(*[
        F.sum(F.when(F.col("one") if side == "one" else ~F.col("one"), F.col(c) * F.col("w"))).alias(f"{side}_{c}")
        for side in ("one", "long") for c in sums])
    gap = lambda num, den: ratio(f"one_{num}", f"one_{den}") - ratio(f"long_{num}", f"long_{den}")
    return totals.select("replicate", gap("delay_sum", "delivered").alias("gap_all"),
                         gap("late_delay_sum", "late").alias("gap_late"))


def tenure_gap_interval(profile: DataFrame, replicates: int = 200, level: float = 0.95, long_months: int = 13,
                        basis: str = "span") -> DataFrame:
    """One row: for ``gap_all`` and ``gap_late`` of :func:`tenure_gap` the
    percentile interval (``_low``, ``_high``) at ``level`` and the standard
    error (``_se``) over the repetitions, and how many of them had a gap
    (a repetition without one-off or long-tenure lines has none)."""
    if replicates < 2 or not 0 < level < 1:
        raise ValueError("replicates must be 2 or more, level between 0 and 1")
    reps = gap_replicates(profile, replicates, long_months, basis)
    low = (1 - level) / 2
    out = []
    for g in ("gap_all", "gap_late"):
        out += [F.round(F.percentile(g, F.lit(low)), ROUND).alias(f"{g}_low"),
                F.round(F.percentile(g, F.lit(1 - low)), ROUND).alias(f"{g}_high"),
                F.round(F.stddev_samp(g), ROUND).alias(f"{g}_se"),
                F.count(g).alias(f"{g}_replicates")]
    return reps.agg(*out)
