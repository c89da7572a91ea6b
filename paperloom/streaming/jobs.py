"""Structured Streaming: idempotent ingest and usage rollups. An addition to the batch operators, which they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files as they arrive, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_papers(stream: DataFrame, hours: int = 24, time: str = "created_at") -> DataFrame:
    """Papers by their file's hash, each once as long as repetitions come within ``hours``; state is dropped behind the watermark."""
    return stream.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark(["file_hash"])


def usage_rollup(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Calls and sums by window and kind; rows later than ``late`` are dropped."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "calls", "value")


def usage_rollup_batch(rows: DataFrame, window: str = "1 hour", time: str = "ts") -> DataFrame:
    """The same of a finished table."""
    return rows.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "calls", "value")


def sessions(rows: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Sessions of users by a gap; streams need a watermark before."""
    return rows.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Give each micro-batch to a function that writes it; with the checkpoint every batch has one number, so that a writer that replaces what it wrote under that number writes each row once."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for ``run``: a batch goes to a folder of its own number, which a repetition replaces."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def progress_events(query: StreamingQuery) -> list[dict]:
    """What a query has done so far: batch, rows in and per second."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]
