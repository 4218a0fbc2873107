"""Canonical tables derived from the driver's TPC-H-like tables.

The test data has no dispatch, delivery or promise dates, no city and no
weight, so they are synthesised by fixed integer rules (FIXTURES.md §3).
Integer arithmetic only, so Spark and the SQL oracle agree exactly.

Every line stays. Sellers differ in tenure because lines are assigned: each
supplier has two lanes, and in each lane one seller follows the other, for 1,
2, 5, 9, 14, 21 and 28 of the 80 months, in an order that differs by supplier
and lane. A line belongs to the seller whose time holds its order month.

Everything is a lazy DataFrame over the raw Parquet files: joins are
equi-joins whose strategy (broadcast or sort-merge) AQE picks from runtime
sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import add_days
from .raw import read_table

# Fixed values of the fixture rules (FIXTURES.md §3).
FIRST_MONTH_YEAR, FIRST_MONTH = 1995, 1      # month index 0 = January 1995
LENGTHS = (1, 2, 5, 9, 14, 21, 28)           # months of a lane's sellers, 80 together
MONTHS = sum(LENGTHS)
LANES = 2
SELLERS_PER_SUPPLIER = LANES * len(LENGTHS)  # seller_id = suppkey*14 + lane*7 + place in the lane
SLOW_EXTRA_DAYS = 6
SHORT_MONTHS = 9
NO_DEADLINE = 7                              # h2 of lines without a shipping deadline
ESTIMATE_MARGIN_DAYS = 9


#: Lines that a task of the line fact joins and reduces, about.
LINES_PER_TASK = 250_000


@dataclass(frozen=True)
class Canonical:
    lines: DataFrame
    sellers: DataFrame
    customers: DataFrame
    products: DataFrame
    cities: DataFrame
    seller_month: DataFrame | None = None  # in prepared stores


def _state_city(region: Column) -> Column:
    """Each state has a city that ends in the state's name."""
    return F.concat(F.lit("Cidade de "), region)


def _dirty_city(name: Column, region: Column, key: Column) -> Column:
    """Raw city text as a marketplace form would hold it: 6 spellings that cleansing mends, and by turns a name in no
    lookup, a typing error, the city that ends in its state's name, and a name equally near to several cities."""
    variant, other = key % 7, key % 4
    rest = (F.when(other == 0, F.concat(F.lit("Nowhere "), (key % 3).cast("string")))
            .when(other == 1, F.replace(name, F.lit("TIO"), F.lit("TO")))
            .when(other == 2, _state_city(F.lower(region)))
            .otherwise(F.lit("Nation")))
    return (F.when(variant == 0, F.upper(name))
            .when(variant == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
            .when(variant == 2, F.translate(name, "_", "-"))
            .when(variant == 3, F.concat(name, F.lit(" / "), region))
            .when(variant == 4, F.translate(F.lower(name), "aeiou", "áéíóú"))
            .when(variant == 5, F.concat(name, F.lit(" - "), region))
            .otherwise(rest))


def lane_starts() -> list[list[int]]:
    """First months of a lane's sellers for each of the 7 rotations of LENGTHS."""
    n = len(LENGTHS)
    return [[sum(LENGTHS[(r + i) % n] for i in range(j)) for j in range(n)] for r in range(n)]


def spread(lines: DataFrame, key: str, n_rows: int, rows_per_task: int = LINES_PER_TASK) -> DataFrame:
    """``lines`` dealt by ``key`` to as many tasks as their number asks for; few stay as they are. What joins them by
    ``key`` follows, so a task sorts and groups about ``rows_per_task`` of them however large the table."""
    tasks = -(-n_rows // rows_per_task)
    return lines.repartition(tasks, key) if tasks > lines.sparkSession.sparkContext.defaultParallelism else lines


def fulfilment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_extendedprice", "l_linestatus")
    # the count reads the files' footers only
    li = spread(li, "l_orderkey", li.count())
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                        "o_orderdate", "o_orderpriority")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")

    n = len(LENGTHS)
    month = F.greatest(F.lit(0), F.least(
        F.lit(MONTHS - 1), F.year("o_orderdate") * 12 + F.month("o_orderdate") - (FIRST_MONTH_YEAR * 12 + FIRST_MONTH)))
    lane = F.col("l_partkey") % LANES
    turn = ((F.col("l_suppkey") + 3 * lane) % n).cast("int")
    starts = lane_starts()
    place = sum(((month >= F.element_at(F.array(*[F.lit(starts[r][j]) for r in range(n)]), turn + 1)).cast("int")
                 for j in range(1, n)), F.lit(0))
    # (The customer table joins last: joined to the orders first, its size
    # estimate without table statistics is a product, and the planner would
    # then broadcast the line side instead.)
    placed = li.join(orders, li.l_orderkey == orders.o_orderkey).withColumns({
        "_seller": F.col("l_suppkey") * SELLERS_PER_SUPPLIER + lane * n + place,
        "_months": F.element_at(F.array(*map(F.lit, LENGTHS)), (turn + place) % n + 1)})
    s, klen = F.col("_seller"), F.col("_months")

    h = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 31
         + F.col("l_linenumber") * 29) % 97
    h2 = (F.col("l_orderkey") * 11 + F.col("l_linenumber") * 5) % 23
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    slow = F.when((s % 11 == 3) | ((s % 11).isin(0, 5) & (klen <= SHORT_MONTHS)), SLOW_EXTRA_DAYS).otherwise(0)
    ship_days = F.greatest(
        F.lit(0), 1 + h % 12 + F.floor(F.col("p_size") / 8) - F.floor(klen / 10) + slow).cast("int")
    limit_days = (9 + prio).cast("int")
    transit = (2 + F.abs(F.col("s_nationkey") - F.col("c_nationkey")) % 6 + h2 % 9).cast("int")
    undelivered = ((F.col("o_orderstatus") == "P") & (F.col("l_linestatus") == "O")
                   & (h % 5 == 0))

    joined = (placed.join(part, placed.l_partkey == part.p_partkey)
              .join(supp, placed.l_suppkey == supp.s_suppkey)
              .join(cust, placed.o_custkey == cust.c_custkey))
    ordered_at = F.col("o_orderdate")
    # one projection for all derived columns (a chain of withColumn calls
    # re-analyses the whole plan once per call on the driver)
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        s.alias("seller_id"),
        F.col("o_custkey").alias("customer_id"),
        ordered_at.alias("ordered_at"),
        F.when(h2 != NO_DEADLINE, add_days(ordered_at, limit_days)).alias("ship_limit_at"),
        add_days(ordered_at, ship_days).alias("shipped_at"),
        F.when(~undelivered, add_days(ordered_at, ship_days + transit)).alias("delivered_at"),
        add_days(ordered_at, limit_days + ESTIMATE_MARGIN_DAYS).alias("estimated_at"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
    )


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey)


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seller a supplier can host (suppkey*14 + 0..13), located in the
    supplier's nation (city) and region (state). A generator, not a join."""
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    geo = _nation_region(spark, sf_dir)
    located = supp.join(geo, supp.s_nationkey == geo.n_nationkey).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SELLERS_PER_SUPPLIER - 1))).alias("_slot"))
    return located.select(
        (F.col("s_suppkey") * SELLERS_PER_SUPPLIER + F.col("_slot")).cast("long").alias("seller_id"),
        _dirty_city(F.col("n_name"), F.col("r_name"), F.col("s_suppkey")).alias("city_raw"),
        F.col("r_name").alias("state"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    geo = _nation_region(spark, sf_dir)
    return cust.join(geo, cust.c_nationkey == geo.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        _dirty_city(F.col("n_name"), F.col("r_name"), F.col("c_custkey")).alias("city_raw"),
        F.col("r_name").alias("state"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    k = F.col("p_partkey")
    huge = k % 50 == 7  # length * width * height beyond 2^31
    return part.select(
        k.alias("product_id"),
        F.col("p_type").alias("category"),
        F.when(k % 17 != 5, F.col("p_size") + (k % 4) * 0.25).cast("double").alias("weight"),
        F.when(huge, 2000).otherwise(F.col("p_size")).alias("length"),
        F.when(huge, 2000).otherwise(1 + k % 5).cast("int").alias("width"),
        F.when(k % 19 != 3, F.when(huge, 2000).otherwise(1 + k % 3)).cast("int").alias("height"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean city lookup: one row per (city, state) with its key."""
    from ..functions.city import city_key

    geo = _nation_region(spark, sf_dir).select(F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    region = read_table(spark, sf_dir, "region", "r_name")
    named = geo.unionByName(region.select(_state_city(F.col("r_name")).alias("city"), F.col("r_name").alias("state")))
    return named.select(city_key(F.col("city")).alias("city_key"), "city", "state")


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seller's sign-up: the first day of its time in the lane."""
    starts = lane_starts()
    n = len(LENGTHS)
    slot = F.explode(F.sequence(F.lit(0), F.lit(SELLERS_PER_SUPPLIER - 1)))
    s = read_table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", slot.alias("_slot"))
    turn = ((F.col("s_suppkey") + 3 * F.floor(F.col("_slot") / n)) % n).cast("int")
    start = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in starts]), turn + 1),
                         (F.col("_slot") % n + 1).cast("int"))
    return s.select(
        (F.col("s_suppkey") * SELLERS_PER_SUPPLIER + F.col("_slot")).cast("long").alias("seller_id"),
        F.add_months(F.make_date(F.lit(FIRST_MONTH_YEAR), F.lit(FIRST_MONTH), F.lit(1)), start)
        .cast("timestamp_ntz").alias("signed_up_at"))


def canonical(spark: SparkSession, sf_dir: str) -> Canonical:
    return Canonical(
        lines=fulfilment_lines(spark, sf_dir),
        sellers=sellers(spark, sf_dir),
        customers=customers(spark, sf_dir),
        products=products(spark, sf_dir),
        cities=cities(spark, sf_dir),
    )
