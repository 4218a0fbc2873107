"""Written steps of operators that move much data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import materialize

#: Spark's own setting: shuffle files go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again. Later steps start at
    the written files, so the step's shuffle files go as soon as it has ended."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Delete a written step that no later one reads."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
