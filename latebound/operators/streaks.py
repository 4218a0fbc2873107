"""A1: habitual lateness as runs of late lines in a row.

A seller's delivered lines in the order of time are cut into runs of late and of
punctual lines. A hot seller's lines must not meet in one task, so runs are found
in ranges and put together:

1. Lines, reduced to what the order needs, are placed in contiguous ranges of
   (seller, time) of about ``rows_per_range`` rows (:mod:`ranking`), written once.
2. In each (seller, range), gaps and islands: the position minus the number
   of late lines so far is equal within a run of late lines. A window per (seller,
   range) holds one range's rows at most.
3. A range's runs become one summary: lines, late lines at its start, at its
   end, longest run, and the runs of ``min_run`` lines or more that touch neither end.
   Summaries are associative; a fold over a seller's summaries in the order of the ranges
   closes the runs that cross from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import count_true
from ..session import materialize
from .ranking import DEFAULT_ROWS_PER_RANGE, place_in_ranges

#: The order of a seller's lines; equal ones count punctual lines first.
LINE_ORDER = ("seller_id", "ordered_at", "order_id", "line_no", "product_id", "late")


def range_summaries(placed: DataFrame, min_run: int) -> DataFrame:
    """One row per (seller, range): ``n, prefix, suffix, longest, runs``."""
    per_range = Window.partitionBy("seller_id", "_range").orderBy("_pos")
    marked = placed.select("seller_id", "_range", "_pos", "late").withColumns({
        "_place": F.row_number().over(per_range),
        "_island": F.row_number().over(per_range) - F.sum("late").over(per_range)})
    # An island holds a run of late lines and the punctual line before it, if there is one.
    islands = marked.groupBy("seller_id", "_range", "_island").agg(
        F.sum("late").cast("long").alias("run"), F.count(F.lit(1)).alias("rows"), F.max("_place").alias("last"))
    # The run at the start is island 0, the only one without a punctual line; the last one is open at the end.
    first = F.col("_island") == 0
    summary = islands.groupBy("seller_id", "_range").agg(
        F.sum("rows").alias("n"), F.sum("run").alias("late"), F.max("run").alias("longest"),
        F.coalesce(F.max(F.when(first, F.col("run"))), F.lit(0)).cast("long").alias("prefix"),
        F.max_by("run", "last").alias("suffix"),
        count_true(~first & (F.col("run") >= min_run)).alias("_runs"))
    open_end = (F.col("prefix") < F.col("n")) & (F.col("suffix") >= min_run)
    return summary.select("seller_id", "_range", "n", "prefix", "suffix", "longest", "late",
                          (F.col("_runs") - F.when(open_end, 1).otherwise(0)).cast("long").alias("runs"))


def merge_summaries(parts: Column, min_run: int) -> Column:
    """Fold of an array of summaries in order: ``longest``, ``current`` (late lines at the end), ``runs``."""
    zero = F.lit(0).cast("long")

    def closed(run: Column) -> Column:
        return F.when(run >= min_run, F.lit(1)).otherwise(F.lit(0)).cast("long")

    def step(acc: Column, s: Column) -> Column:
        joined = acc["current"] + s["prefix"]
        all_late = s["prefix"] == s["n"]
        return F.struct(
            F.greatest(acc["longest"], joined, s["longest"]).alias("longest"),
            F.when(all_late, joined).otherwise(s["suffix"]).alias("current"),
            (acc["runs"] + F.when(all_late, zero).otherwise(s["runs"] + closed(joined))).alias("runs"))

    start = F.struct(zero.alias("longest"), zero.alias("current"), zero.alias("runs"))
    return F.aggregate(parts, start, step, lambda acc: F.struct(
        acc["longest"].alias("longest"), acc["current"].alias("current"),
        (acc["runs"] + closed(acc["current"])).alias("runs")))


def seller_late_streaks(attributed: DataFrame, min_run: int = 3,
                        rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> DataFrame:
    """Per seller with a delivered line: ``delivered``, ``late``,
    ``longest_streak`` (late lines in a row, in the order of time),
    ``current_streak`` (late lines since the last punctual one) and
    ``streaks`` (runs of at least ``min_run`` late lines).

    Undelivered lines are skipped. Lines of one moment are ordered by order,
    line and product, punctual ones first if all that is equal."""
    lines = materialize(attributed.where(F.col("late").isNotNull()).select(*LINE_ORDER), "streak_lines")
    placed = place_in_ranges(lines, [(c, True) for c in LINE_ORDER], rows_per_range)
    parts = range_summaries(placed, min_run).groupBy("seller_id").agg(
        F.sort_array(F.collect_list(F.struct("_range", "n", "prefix", "suffix", "longest", "late", "runs"))).alias("parts"))
    merged = parts.withColumn("m", merge_summaries(F.col("parts"), min_run))
    total = lambda f: F.aggregate("parts", F.lit(0).cast("long"), lambda a, s: a + s[f])
    return merged.select("seller_id", total("n").alias("delivered"), total("late").alias("late"),
                         F.col("m.longest").alias("longest_streak"), F.col("m.current").alias("current_streak"),
                         F.col("m.runs").alias("streaks"))


def streak_black_sellers(scores: DataFrame, streaks: DataFrame, m_tier: int = 5, min_streak: int = 3,
                         min_streaks: int = 1) -> DataFrame:
    """Top-revenue sellers (``m_score >= m_tier`` of ``rfm_scores``) whose
    delays come in a row: a run of at least ``min_streak`` late lines, and at
    least ``min_streaks`` such runs by the streaks' own ``min_run``."""
    runs = streaks.select("seller_id", "longest_streak", "current_streak", "streaks")
    return (scores.where(F.col("m_score") >= m_tier).join(runs, "seller_id")
            .where((F.col("longest_streak") >= min_streak) & (F.col("streaks") >= min_streaks))
            .select("seller_id", "monetary", "revenue_share", "delivered", "late_lines", "late_rate",
                    "longest_streak", "current_streak", "streaks"))
