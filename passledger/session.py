"""Session helpers: a tuned local builder for tests and bench, and checkpoint placement."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int | None = None, app: str = "passledger") -> SparkSession:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints: the session's setting; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="passledger-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder beside the checkpoints (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written: else they stay until the driver's garbage is collected."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write the rows once to a table in the shared checkpoint folder and go on from there.

    Lineage ends at the table, a lost executor costs nothing upstream, and later stages read only the columns they need
    with real sizes for the planner. ``compression`` is the codec of the table's files. Of the step only the table is left:
    its shuffle files are dropped.
    """
    path = fresh_dir(df.sparkSession, "cut")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """This side of a join is shuffled by key, not broadcast.

    The planner's estimate of rows behind a generator is that of the small compressed files they come from: it does not count
    how many rows the generator makes of one, so rows by the million would be collected on the driver.
    """
    return df.hint("merge")


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_bytes(spark: SparkSession, files: list[str]) -> int:
    sizes = (system.getFileStatus(at).getLen() for at, system in (_folder(spark, f) for f in files))
    return sum(sizes)


def forget(table: DataFrame) -> None:
    """Delete a table made by ``cut`` from which no later step reads."""
    files = table.inputFiles()
    if files:
        at, system = _folder(table.sparkSession, files[0])
        system.delete(at.getParent(), True)
