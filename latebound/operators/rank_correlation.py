"""A6 by ranks: Spearman's rho and Kendall's tau-b, which outliers and bent relations leave alone.

Discordant pairs are inversions. Rows numbered by (x, y) as ``p`` and by (y, x)
as ``q`` are discordant where ``p`` rises and ``q`` falls; a pair tied in x or y
rises in both, so ties need no care. Two numbers differ first in one bit of
``q``: per bit, the rows that agree above it form a group, and each row with
the bit off counts those with the bit on that have a smaller ``p`` (the merge
steps of a merge sort, all at once). A group is cut into blocks of ``p``: pairs
inside a block are counted by a window over that block, pairs across blocks by
the blocks' sums merged in order, so no window holds more than a block's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import correlation
from ..session import materialize
from .deciles import ROUND, blame_by_grain
from .ranking import DEFAULT_ROWS_PER_RANGE, global_row_number

#: Bits of the number inside a block: a block holds 65,536 rows at most.
BLOCK_BITS = 16
#: A value's rows are spread over so many parts when they meet its middle rank.
SPREAD = 8

#: name of the pair: (x, y)
SPEC_PAIRS = {"share_weight": ("blame_share", "avg_weight"), "share_volume": ("blame_share", "avg_volume"),
              "weight_dispatch": ("avg_weight", "avg_ship_days"), "share_dispatch": ("blame_share", "avg_ship_days")}


def inversions(ranked: DataFrame, bits: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``pair, discordant`` of rows ``pair, p, q`` with numbers below ``2 ** bits``."""
    rows = ranked.select("pair", "p", "q", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    rows = rows.select("pair", "bit", F.expr("shiftright(q, bit + 1)").alias("head"),
                       F.shiftright("p", block_bits).alias("block"), "p",
                       F.expr("shiftright(q, bit) & 1").alias("on"))
    group = ["pair", "bit", "head"]
    above = F.sum("on").over(Window.partitionBy(*group, "block").orderBy("p"))
    blocks = (rows.withColumn("above", above).groupBy(*group, "block")
              .agg(F.sum("on").alias("ones"), F.sum(1 - F.col("on")).alias("zeros"),
                   F.sum(F.when(F.col("on") == 0, F.col("above"))).alias("inside")))
    before = F.sum("ones").over(Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return (blocks.withColumn("before", F.coalesce(before, F.lit(0)))
            .groupBy("pair").agg(F.sum(F.coalesce("inside", F.lit(0)) + F.col("zeros") * F.col("before"))
                                 .cast("long").alias("discordant")))


def _with_middle(rows: DataFrame, value: str, number: str, out: str) -> DataFrame:
    """``rows`` with the mean of ``number`` over the rows of their ``value``; a value held by many rows is spread."""
    middles = (rows.groupBy("pair", value).agg((F.sum(number) / F.count(F.lit(1))).alias(out))
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))))
    return rows.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(SPREAD)).cast("int")).join(
        middles, ["pair", value, "part"]).drop("part")


def rank_correlation(rows: DataFrame, pairs: dict[str, tuple[str, str]], key: str,
                     rows_per_range: int = DEFAULT_ROWS_PER_RANGE, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per entry of ``pairs`` (name to two numeric columns): ``pair,
    rows, discordant`` (pairs of rows that rise in one and fall in the other),
    ``spearman`` (Pearson's coefficient of middle ranks) and ``kendall`` (tau-b).

    ``key`` is unique. Values are compared after rounding to 6 places, so sums added in another order tie alike; rows without
    one of the two values do not take part. A coefficient is null where a column has one value only; pairs
    without rows have no row. All pairs are numbered together, in two range orders, whatever their number."""
    entries = F.array(*[F.struct(F.lit(n).alias("pair"), F.round(F.col(x).cast("double"), ROUND).alias("x"),
                                 F.round(F.col(y).cast("double"), ROUND).alias("y")) for n, (x, y) in pairs.items()])
    long = rows.select(F.col(key).alias("key"), F.explode(entries).alias("e")).select("e.pair", "e.x", "e.y", "key")
    long = materialize(long.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "rank_pairs")
    by_x = [("pair", True), ("x", True), ("y", True), ("key", True)]
    by_y = [("pair", True), ("y", True), ("x", True), ("key", True)]
    numbered, n = global_row_number(long, by_x, "p", rows_per_range)
    numbered, _ = global_row_number(numbered, by_y, "q", rows_per_range, n_rows=n)
    numbered = materialize(numbered, "rank_numbers")
    middle = _with_middle(_with_middle(numbered, "x", "p", "mx"), "y", "q", "my")
    rho = middle.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), correlation("mx", "my").alias("rho"),
                                     (F.min("x") == F.max("x")).alias("one_x"), (F.min("y") == F.max("y")).alias("one_y"))

    def tied(cols: list[str], out: str) -> DataFrame:
        c = numbered.groupBy("pair", *cols).agg(F.count(F.lit(1)).alias("c"))
        return c.groupBy("pair").agg(F.sum(F.expr("c * (c - 1) div 2")).alias(out))

    parts = [rho, inversions(numbered, max(1, n.bit_length()), block_bits),
             tied(["x"], "tx"), tied(["y"], "ty"), tied(["x", "y"], "txy")]
    all_ = reduce(lambda a, b: a.join(b, "pair"), parts)  # a row per pair each
    n0 = F.expr("rows * (rows - 1) div 2")
    score = n0 - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("discordant")
    scale = F.sqrt((n0 - F.col("tx")).cast("double")) * F.sqrt((n0 - F.col("ty")).cast("double"))
    constant = F.col("one_x") | F.col("one_y")
    return all_.select("pair", F.col("rows").cast("long").alias("rows"), "discordant",
                       F.round(F.when(~constant, F.col("rho")), ROUND).alias("spearman"),
                       F.round(F.try_divide(score.cast("double"), F.nullif(scale, F.lit(0.0))), ROUND).alias("kendall"))


def spec_delay_rank_correlation(attributed: DataFrame, products: DataFrame, min_late: int = 1, grain: str = "seller_id",
                                rows_per_range: int = DEFAULT_ROWS_PER_RANGE, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The pairs of :func:`spec_delay_correlation` by ranks, one row each (:func:`rank_correlation`)."""
    grains = blame_by_grain(attributed, products, grain, min_late)
    return rank_correlation(grains, SPEC_PAIRS, grain, rows_per_range, block_bits)
