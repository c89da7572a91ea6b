"""Session helpers: shared scratch tables that outlive a lost executor, and table reading."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores if it has fewer partitions than there are cores, as a small table in one file has; else as they are, so a large table isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _partitions(df) < cores else df


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to as many partitions as their scan has, and no fewer than cores: what is made of a row and grouped by its key and more isn't shuffled again."""
    return df.repartition(max(_partitions(df), df.sparkSession.sparkContext.defaultParallelism), key)


def _partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only a local master may go without: there a
    temporary folder serves, since driver and executors are the same process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="paperloom-")
    return f"file://{_local[app]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/paperloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Give Python workers at most ``rows`` rows at a time, so that long texts don't fill their memory.

    A lazy result is planned after its operator has returned, so the bound holds from here on in this session; it is never raised.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """The same for what is executed inside, whose rows are large; the setting before holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles that no live object refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """A DataFrame written to the shared folder and read back: lineage ends here, and it survives lost executors."""

    def __init__(self, df: DataFrame, tag: str):
        self._spark = df.sparkSession
        self.path = scratch_path(self._spark, tag)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Give the space back once nothing lazy reads the table any more."""
        remove(self._spark, self.path)
