"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings every job of this package expects. Sizes suit a cluster; callers
#: override them (tests use eight shuffle partitions).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Captured pages are wide rows, so an Arrow batch is bounded by rows here.
    ARROW_ROWS: "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    STATE_STORE: ROCKSDB,
}


def build_session(app_name: str = "rolecall", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with :data:`DEFAULT_CONF`, then ``conf`` on top."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rolecall-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    true size, so its own broadcast threshold decides the next join.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it lasts, tasks that start hand Python ``most`` rows at a time, or fewer if the
    session says so. An executor and its workers hold a batch each, several times over."""
    before = spark.conf.get(ARROW_ROWS)
    if 0 < int(before) <= most:
        yield
        return
    spark.conf.set(ARROW_ROWS, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def shared_files(spark: SparkSession, path: str):
    """The file system that Spark reads ``path`` from, and the path as it names
    it. Spark itself has no call to delete or rename a folder."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


class Scratch:
    """Intermediate tables that go together once nothing reads them any more.

    Whatever outlives :meth:`clear` has to be written with :func:`materialize`,
    so that a lost executor never asks for a table that is gone.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = scratch_path(spark, "steps")

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Writes ``df`` and reads it back, as :func:`materialize` does."""
        path = f"{self._folder}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables."""
        files, folder = shared_files(self._spark, self._folder)
        files.delete(folder, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.clear()
