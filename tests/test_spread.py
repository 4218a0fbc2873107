"""The line fact is dealt to as many tasks as its rows ask for."""

from latebound.sources import fixture
from latebound.sources.fixture import LINES_PER_TASK, spread
from pyspark.sql import functions as F


def test_tasks_follow_the_rows(spark):
    lines = spark.range(20_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), "id")
    for n in (40, 80):
        dealt = spread(lines, "l_orderkey", 20_000, 20_000 // n)
        placed = dealt.withColumn("p", F.spark_partition_id())
        held = placed.groupBy("p").agg(F.count("id").alias("rows")).collect()
        assert dealt.rdd.getNumPartitions() == n and sum(r["rows"] for r in held) == 20_000
        assert max(r["rows"] for r in held) < 2 * 20_000 / n
        assert placed.groupBy("l_orderkey").agg(F.countDistinct("p").alias("k")).filter("k > 1").count() == 0
    assert spread(lines, "l_orderkey", 20_000) is lines
    assert LINES_PER_TASK <= 1_000_000


def test_same_lines_and_one_exchange(spark, monkeypatch):
    """What is dealt is joined where it lies: the lines move once, and are the same."""
    sf = "/root/testdata/sf0.001"
    few = fixture.fulfilment_lines(spark, sf)
    monkeypatch.setattr(fixture.spread, "__defaults__", (100,))
    many = fixture.fulfilment_lines(spark, sf)
    plan = many._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning(l_orderkey") == 1 and plan.count("hashpartitioning(o_orderkey") <= 1
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0
