"""Global row numbers and NTILE without moving all rows into one task.

``F.ntile(n).over(Window.orderBy(...))`` has no ``partitionBy``, so Spark
moves every row to one task (``Exchange SinglePartition``). Here the order
is cut into contiguous ranges of about ``rows_per_range`` rows, two at least:

1. ``repartitionByRange(P, order)`` places each row in its range (Spark's
   range partitioner samples the keys, a bounded sample per input
   partition, and binary-searches the bounds per row), and
   ``sortWithinPartitions`` orders each range;
2. the range id (``spark_partition_id``) and the position inside the range
   (``monotonically_increasing_id`` minus the range's base) are written
   with the rows to the checkpoint folder, so every later read sees the
   same placement (a recomputed range partitioning could choose other
   bounds);
3. one aggregate counts rows per range; a running sum turns the counts
   into offsets, which are joined; global row number = offset + position + 1.

NTILE needs less: only the order's columns are placed, the first rows of the
bins are read at their global positions (exact order statistics), and the bin
of a row is a comparison with them.

The order ends with a unique key, so ties in the value never pile into one
range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import materialize

# (column name, ascending)
OrderSpec = Sequence[tuple[str, bool]]

DEFAULT_ROWS_PER_RANGE = 250_000

def _order_cols(order: OrderSpec) -> list[Column]:
    return [F.col(n).asc() if asc else F.col(n).desc() for n, asc in order]


def place_in_ranges(df: DataFrame, order: OrderSpec, rows_per_range: int = DEFAULT_ROWS_PER_RANGE,
                    n_rows: int | None = None) -> DataFrame:
    """``df`` written in contiguous ranges of ``order``, with ``_range`` and the position ``_pos`` inside it."""
    if n_rows is None:
        n_rows = df.count()
    cols = _order_cols(order)
    n_ranges = max(2, math.ceil(n_rows / max(1, rows_per_range)))
    placed = (df.repartitionByRange(n_ranges, *cols)
              .sortWithinPartitions(*cols)
              .withColumn("_range", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_range").cast("long"), 33)))
    return materialize(placed, "ranged")


def _with_offsets(placed: DataFrame) -> DataFrame:
    """Placed rows with ``_offset``, the rows in the ranges before (a running
    sum over the counts per range, one row per range, joined back)."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
               .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_offset")))
    return placed.join(offsets, "_range")


def global_row_number(df: DataFrame, order: OrderSpec, out: str = "rn",
                      rows_per_range: int = DEFAULT_ROWS_PER_RANGE,
                      n_rows: int | None = None,
                      source: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Add ``out`` = 1-based position of each row in ``order``.

    ``order`` must be a total order (end it with a unique key) over non-NULL
    columns. ``n_rows`` saves a count when the caller knows it; ``source``
    (same rows as ``df``, e.g. the materialized table ``df`` derives from)
    is what that count reads. Returns the frame and the row count.
    """
    if n_rows is None:
        n_rows = (df if source is None else source).count()
    placed = place_in_ranges(df, order, rows_per_range, n_rows)
    ranked = _with_offsets(placed).withColumn(
        out, (F.col("_offset") + F.col("_pos") + 1).cast("long"))
    return ranked.drop("_range", "_pos", "_offset"), n_rows


def rows_at(df: DataFrame, order: OrderSpec, positions: Sequence[int], rows_per_range: int = DEFAULT_ROWS_PER_RANGE,
            n_rows: int | None = None) -> list[Row]:
    """The rows of ``df`` at the 1-based ``positions`` (few) of ``order``, in that order: exact order statistics.
    ``df`` should hold the key columns only; they are all that is shuffled and written."""
    if not positions:
        return []
    placed = place_in_ranges(df, order, rows_per_range, n_rows)
    rn = (F.col("_offset") + F.col("_pos") + 1).cast("long")
    found = _with_offsets(placed).withColumn("_rn", rn).where(F.col("_rn").isin(list(positions))).collect()
    return sorted(found, key=lambda r: r["_rn"])


def bin_starts(n_rows: int, n_bins: int) -> list[int]:
    """1-based positions of the first row of the second and later NTILE bins."""
    q, r = divmod(n_rows, n_bins)
    return [b * q + min(b, r) + 1 for b in range(1, min(n_bins, n_rows))]


def bin_of(keys: Sequence[tuple[Column, bool]], starts: Sequence[Sequence]) -> Column:
    """1 plus the number of ``starts`` (key tuples) that are not after the row, by ``keys`` (column, ascending)."""
    def reached(start: Sequence) -> Column:
        out = F.lit(True)
        for (c, asc), v in reversed(list(zip(keys, start))):
            out = ((c > v) if asc else (c < v)) | ((c == v) & out)
        return out

    return sum((reached(s).cast("int") for s in starts), F.lit(1)).cast("int")


def ntile_from_row_number(rn: Column, n_rows: int, n_bins: int) -> Column:
    """NTILE(n_bins) of a 1-based row number among ``n_rows`` rows: the first
    ``n_rows % n_bins`` bins hold one row more, as SQL's NTILE does."""
    q, r = divmod(n_rows, n_bins)
    big = r * (q + 1)
    if q == 0:
        return rn.cast("int")
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = F.floor((rn - big - 1) / q) + 1 + r
    return F.when(rn <= big, first).otherwise(rest).cast("int")


#: Up to so many bins, the bins' first rows become literals; beyond it rows are numbered and joined.
LITERAL_BINS = 100


def ntile(df: DataFrame, n_bins: int, order: OrderSpec, out: str = "ntile",
          rows_per_range: int = DEFAULT_ROWS_PER_RANGE, n_rows: int | None = None,
          source: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = NTILE(n_bins) over ``order`` (a total order, no NULLs).

    Only the order's columns are ranged and written; the first rows of the
    bins are looked up, and the bin is a comparison with them, a projection
    of ``df``. ``df`` is read twice, so it should be a written table."""
    if n_rows is None:
        n_rows = (df if source is None else source).count()
    if n_bins > LITERAL_BINS:
        ranked, _ = global_row_number(df, order, out="_rn", rows_per_range=rows_per_range, n_rows=n_rows)
        return ranked.withColumn(out, ntile_from_row_number(F.col("_rn"), n_rows, n_bins)).drop("_rn")
    names = [c for c, _ in order]
    edges = rows_at(df.select(*names), order, bin_starts(n_rows, n_bins), rows_per_range, n_rows)
    return df.withColumn(out, bin_of([(F.col(c), asc) for c, asc in order], [[e[c] for c in names] for e in edges]))
