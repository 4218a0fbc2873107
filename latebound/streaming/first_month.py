"""Early monitoring of new sellers as a Structured Streaming job.

Lines arrive as a stream (e.g. the day's completed order lines). A streaming
aggregation with a watermark keeps, per seller, month of order and ``span`` of
time, the delivered and late lines and the revenue; partial sums before the
shuffle reduce a hot seller's lines to a row per task. The month is that of the
order's own calendar (the session's time zone for zoned timestamps); spans only
say when state may go. Built-in functions only, no Python on the
workers. Each micro-batch writes the rows it changed; the latest state of the
rows gives each seller's first month and its label.

A line is dropped when its span ended before the watermark of the batches
before; whether other lines share its file makes no difference. Sellers known
from before the stream began (``known``) keep their first month, so an
established seller does not count as new when the monitor is switched on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_index, month_label
from ..operators.cohorts import first_month_label
from ..session import owned_folder


def line_events(attributed: DataFrame) -> DataFrame:
    """The columns the monitor needs, from attributed canonical lines (batch
    or streaming): the month ``m`` of the order as its timestamp says, and
    ``ordered_at`` as a zoned timestamp for the watermark; money travels as
    exact cents. Ids keep their type."""
    return attributed.select(
        "seller_id",
        month_index("ordered_at").alias("m"),
        F.col("ordered_at").cast("timestamp").alias("ordered_at"),
        "late",
        (F.col("price") * 100).cast("long").alias("cents"))


def first_month_monitor(events: DataFrame, delay: str = "7 days", span: str = "1 day") -> DataFrame:
    """Streaming ``seller_id, m, start, delivered, late, cents`` (update mode):
    the sums of a seller's month inside a span of time so far, whenever they
    change. ``events`` is as :func:`line_events` gives it (without ``m``, the
    month is taken in the session's time zone); ``delay`` is how late a line
    may arrive, and ``span`` how finely that is judged: longer spans keep
    fewer rows of state and drop lines later."""
    month = F.col("m") if "m" in events.columns else month_index("ordered_at")
    return (events.withColumn("m", month).withWatermark("ordered_at", delay)
            .groupBy("seller_id", "m", F.window("ordered_at", span).alias("span"))
            .agg(F.count("late").alias("delivered"),
                 F.sum(F.when(F.col("late") == 1, 1).otherwise(0)).cast("long").alias("late"),
                 F.sum("cents").cast("long").alias("cents"))
            .withColumn("span", F.col("span.start")).withColumnRenamed("span", "start"))


def label_records(records: DataFrame, known: DataFrame | None = None, excellent_max: float = 0.0,
                  severe_min: float = 0.5) -> DataFrame:
    """First month per seller from the monitor's rows (with the number of
    their ``batch``), labelled like the batch cohorts. ``known`` has the
    sellers of before, ``seller_id, first_m``; they are left out unless the
    stream holds an earlier month."""
    latest = (records.groupBy("seller_id", "m", "start")
              .agg(F.max_by(F.struct("delivered", "late", "cents"), "batch").alias("r")))
    months = latest.groupBy("seller_id", "m").agg(
        *[F.sum(f"r.{c}").cast("long").alias(c) for c in ("delivered", "late", "cents")])
    first = months.groupBy("seller_id").agg(
        F.min("m").alias("first_m"),
        *[F.min_by(c, "m").alias(c) for c in ("delivered", "late", "cents")])
    if known is not None:
        before = known.select("seller_id", F.col("first_m").alias("_known"))
        first = (first.join(before, "seller_id", "left")
                 .where(F.col("_known").isNull() | (F.col("first_m") < F.col("_known"))).drop("_known"))
    rate = F.try_divide(F.col("late").cast("double"), F.col("delivered").cast("double"))
    return first.select(
        "seller_id", month_label(F.col("first_m")).alias("first_month"), "delivered", "late",
        rate.alias("rate"), first_month_label(rate, excellent_max, severe_min).alias("label"),
        (F.col("cents").cast("decimal(20,0)") / 100).cast("double").alias("first_revenue"))


def run_monitor(stream: DataFrame, root: str, delay: str = "7 days", span: str = "1 day") -> DataFrame:
    """Run the monitor over what the stream has now and return its rows so
    far. ``root`` keeps the query's checkpoint and the rows; calling again
    with the same ``root`` goes on from there. ``foreachBatch`` overwrites a
    batch's folder, so a batch that is repeated after a failure counts once."""
    spark = stream.sparkSession
    rows = first_month_monitor(stream, delay, span)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (rows.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
             .foreachBatch(sink).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/out")


def replay_first_month(spark: SparkSession, attributed: DataFrame, known: DataFrame | None = None,
                       delay: str = "7 days", files_per_trigger: int | None = None, span: str = "30 days") -> DataFrame:
    """Replay attributed lines through the monitor and return the labelled
    result (equal to the batch cohorts). The lines are derived and written
    once. Files are not ordered by time, so with ``files_per_trigger`` the
    ``delay`` must cover the span of the data; without it one batch reads all."""
    root = owned_folder(spark, "stream")
    events = line_events(attributed)
    events.write.parquet(f"{root}/in")
    reader = spark.readStream.schema(events.schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return label_records(run_monitor(reader.parquet(f"{root}/in"), root, delay, span), known)
