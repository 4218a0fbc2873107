"""Session helpers: a tuned local session for tests/bench and the shared
folder used to cut lineage.

Operators never create sessions themselves; they take DataFrames. These
helpers exist for tests, ``bench.py`` and ``__spark_entry__.py``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_MATERIALIZE_SUBDIR = "latebound"
# Folders written by this process: (Hadoop path, Hadoop configuration).
_OWNED: list[tuple] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "latebound", java_options: str | None = None) -> SparkSession:
    """A local session configured the way a cluster job would be: AQE on
    (coalescing, skew-join splitting), UI off, UTC, Arrow enabled."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if java_options:
        builder = builder.config("spark.driver.extraJavaOptions", java_options)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session without one gets a
    private temporary folder (tests); a cluster session without one is a
    configuration error, because a machine-local folder would not survive
    the loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            root = None
    if not root:
        current = sc.getCheckpointDir()
        if current:
            root = current
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so materialized intermediates survive executor loss")
        root = tempfile.mkdtemp(prefix="latebound-ckpt-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Used before an operator reads the same intermediate more than once, or
    where its placement must not change. Unlike ``DataFrame.checkpoint`` this
    computes the input once, and unlike a cache the result survives executor
    loss: the reread plan starts at files in the shared folder, not at the
    lineage. The folder goes at the end of the innermost :func:`intermediates`
    block around the call, or else when the process ends.
    """
    spark = df.sparkSession
    path = owned_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def owned_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, deleted like those of :func:`materialize`."""
    path = f"{checkpoint_root(spark)}/{_MATERIALIZE_SUBDIR}/{name}-{uuid.uuid4().hex}"
    _OWNED.append((spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def _delete_owned(keep: int = 0) -> None:
    while len(_OWNED) > keep:
        path, conf = _OWNED.pop()
        with suppress(Exception):  # the JVM may be gone when the process ends
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def intermediates() -> Iterator[None]:
    """Delete what is materialized inside the block when it ends. Results that
    read it must be collected or written before."""
    before = len(_OWNED)
    try:
        yield
    finally:
        _delete_owned(before)


atexit.register(_delete_owned)
