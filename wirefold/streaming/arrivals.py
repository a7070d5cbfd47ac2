"""Rows that land in a folder of a table, delivered to a sink once per run: the table-shaped sibling of
``new_sources``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_arrivals(spark: SparkSession, landing: str, schema: T.StructType, *, sink: str, checkpoint: str,
                    keep: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_epoch: int | None = None) -> int:
    """Deliver what landed in ``landing`` (Parquet files of ``schema``) since the last run
    (``availableNow``); returns the number of epochs run.

    The file source keeps the delivered files in ``checkpoint``. Every epoch overwrites its own
    folder of ``sink``, so an epoch that is run again after a lost driver (written, not committed)
    leaves its rows once. ``files_per_epoch`` bounds an epoch; nothing passes through the driver.
    An empty or unchanged folder runs no epoch. Both folders must be shared and durable.
    """
    stream = spark.readStream.schema(schema)
    if files_per_epoch:
        stream = stream.option("maxFilesPerTrigger", files_per_epoch)
    epochs = []

    def handle(batch: DataFrame, epoch: int) -> None:
        (keep(batch).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .parquet(f"{sink.rstrip('/')}/epoch={epoch}"))
        epochs.append(epoch)

    (stream.parquet(landing).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
     .foreachBatch(handle).start().awaitTermination())
    return len(epochs)


def delivered(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """All rows of the sink with their ``epoch``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(sink)


def uncommit(spark: SparkSession, checkpoint: str) -> int | None:
    """Forget that the last epoch was committed, as if the driver had been lost right before: the next
    run plans the same files under the same epoch again. Returns the epoch, None without any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    epochs = [int(n) for n in names if n.isdigit()]
    if not epochs:
        return None
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(max(epochs))), False)
    return max(epochs)
