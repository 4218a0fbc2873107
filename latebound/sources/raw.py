"""Readers for the driver's Parquet tables and a generic Parquet/CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared layouts of the driver tables. With a declared schema the reader
# starts no footer-inference job per table (one per read otherwise, and a
# scan of footers over thousands of files at scale).
RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": ("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                 "c_mktsegment STRING"),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": ("p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
             "p_retailprice DOUBLE"),
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                 "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                 "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of ``sf_dir`` with only the named columns (column pruning
    reaches the Parquet ``ReadSchema``)."""
    reader = spark.read
    if name in RAW_SCHEMAS:
        reader = reader.schema(RAW_SCHEMAS[name])
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


CITY_LOOKUP_SCHEMA = "city STRING, state STRING"


def read_city_lookup(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A clean city list (``city, state``) from CSV (with header) or Parquet,
    with its lookup key added: the ``cities`` table of the canonical model."""
    from ..functions.city import city_key

    reader = spark.read.schema(CITY_LOOKUP_SCHEMA)
    df = reader.option("header", "true").csv(path) if fmt == "csv" else reader.parquet(path)
    return df.select(city_key("city").alias("city_key"), "city", "state")


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sink for a result table (Parquet by default, CSV for hand-off)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)
