"""Prepared canonical tables: derive once, analyse many times.

At scale the canonical fact should not be re-derived by every analysis.
``write_canonical`` writes the five tables once as Parquet, and the seller-month
aggregate that most seller analyses start from as a sixth. The fact is
partitioned by order month (month-bounded analyses prune whole folders) and
sorted by seller inside each file (row-group statistics skip sellers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_index, month_label
from ..session import materialize
from .fixture import Canonical

TABLES = ("lines", "sellers", "customers", "products", "cities")
MONTH_COL = "order_month"


def _write_lines(lines: DataFrame, path: str, files: int | None, **options) -> None:
    lines = lines.withColumn(MONTH_COL, month_label(month_index("ordered_at")))
    lines = (lines.hint("rebalance", F.col(MONTH_COL)) if files is None
             else lines.repartitionByRange(files, MONTH_COL, "seller_id", "order_id"))
    (lines.sortWithinPartitions(MONTH_COL, "seller_id")
     .write.mode("overwrite").options(**options).partitionBy(MONTH_COL).parquet(f"{path}/lines"))


def _write_seller_month(lines: DataFrame, path: str, **options) -> None:
    from ..operators import delay_attribution, enrich, seller_month

    months = seller_month(delay_attribution(enrich(lines))).withColumn(MONTH_COL, month_label("m_idx"))
    (months.hint("rebalance", F.col(MONTH_COL)).write.mode("overwrite").options(**options)
     .partitionBy(MONTH_COL).parquet(f"{path}/seller_month"))


def write_canonical(tables: Canonical, path: str, files: int | None = None) -> None:
    """Write ``tables`` under ``path`` (one folder per table).

    By default Spark rebalances the fact by month: adaptive execution cuts
    months into tasks of its advisory partition size, so the number of files
    follows the data. With ``files``, the fact is range-partitioned on (month,
    seller, order) into that many tasks.
    """
    path = path.rstrip("/")
    _write_lines(tables.lines, path, files)
    for name in TABLES[1:]:
        getattr(tables, name).write.mode("overwrite").parquet(f"{path}/{name}")
    # from the lines just written, not from the raw tables again
    _write_seller_month(tables.lines.sparkSession.read.parquet(f"{path}/lines"), path)


def append_lines(lines: DataFrame, path: str, files: int | None = None) -> list[str]:
    """Add ``lines`` (canonical) to the store at ``path`` and return their
    months. Only these months are read and rewritten, in the fact and in the seller-month
    aggregate (dynamic partition overwrite); all other files stay as they are.

    Lines are added as they come: a line that the store has already is there twice. The months' old and new
    lines are written to the checkpoint folder first, so a failure leaves the store as it was or, between the two
    tables, an aggregate that a repeat of :func:`refresh_months` mends."""
    spark, path = lines.sparkSession, path.rstrip("/")
    new = lines.withColumn(MONTH_COL, month_label(month_index("ordered_at")))
    months = sorted(r[0] for r in new.select(MONTH_COL).distinct().collect())  # one row per month
    if not months:
        return months
    store = spark.read.parquet(f"{path}/lines")
    merged = materialize(store.where(F.col(MONTH_COL).isin(months)).unionByName(new.select(*store.columns)), "store_months")
    _write_lines(merged.drop(MONTH_COL), path, files, partitionOverwriteMode="dynamic")
    refresh_months(spark, path, months)
    return months


def refresh_months(spark: SparkSession, path: str, months: list[str]) -> None:
    """Derive the seller-month aggregate of ``months`` (``yyyy-MM``) again from the store's lines."""
    path = path.rstrip("/")
    lines = spark.read.parquet(f"{path}/lines").where(F.col(MONTH_COL).isin(months))
    _write_seller_month(lines, path, partitionOverwriteMode="dynamic")


def read_canonical(spark: SparkSession, path: str) -> Canonical:
    """The tables that :func:`write_canonical` wrote, as a handle that the catalog's queries take."""
    path = path.rstrip("/")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in (*TABLES, "seller_month")}
    return Canonical(**{**tables, "seller_month": tables["seller_month"].drop(MONTH_COL)})


def months_between_filter(df: DataFrame, first: str, last: str) -> DataFrame:
    """Keep lines ordered in months ``first``..``last`` (``yyyy-MM``); on a
    prepared fact read with its partition column this prunes folders."""
    if MONTH_COL in df.columns:
        return df.where(F.col(MONTH_COL).between(first, last))
    label = month_label(month_index("ordered_at"))
    return df.where(label.between(first, last))
