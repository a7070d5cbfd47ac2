"""Newly landed source files, incrementally: Structured Streaming over ``binaryFile``.

The file source remembers which paths it has delivered (in the checkpoint), so each run picks
up arrivals only. It does not re-deliver a modified file, so edits and deletions are the batch
``snapshot_diff``'s job; this stream covers arrivals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.sources.files import _as_uri, relative_to, source_set, text_of

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def new_sources(spark: SparkSession, root: str, *, repo: str, snapshot: str) -> DataFrame:
    """Streaming DataFrame of ``.java`` files under ``root`` with their source set and text; a file
    with bytes that are no UTF-8 is marked ``malformed`` and its bad bytes are replaced."""
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java")
              .load(root))
    rel = relative_to("path", _as_uri(spark, root))
    return stream.select(
        F.lit(repo).alias("repo"), F.lit(snapshot).alias("snapshot"), rel.alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        source_set(rel).alias("source_set"),
        (~F.is_valid_utf8(F.col("content").cast("string"))).alias("malformed"),
        text_of("content").alias("content"))


def stream_new_sources(spark: SparkSession, root: str, *, repo: str, snapshot: str,
                       sink: str, checkpoint: str,
                       on_batch: Callable[[DataFrame, int], None] | None = None) -> int:
    """Run once over everything that arrived since the last run (``availableNow``), write the
    kept files to ``sink`` (Parquet, partitioned by epoch/repo/snapshot/source_set) and hand each
    micro-batch to ``on_batch`` (e.g. fact extraction). Returns the number of files written. An
    epoch replaces its own folder, so a batch that is tried again leaves its rows once.

    ``checkpoint`` must be a shared, durable folder: it is what makes reruns incremental and
    lets a restarted job resume after an executor or driver loss.
    """
    appended = []

    def handle(batch: DataFrame, epoch: int) -> None:
        kept = batch.where(F.col("source_set") != "excluded")
        kept = kept.persist()
        n = kept.count()
        if n:
            (kept.write.mode("overwrite").option("partitionOverwriteMode", "static")
             .partitionBy("repo", "snapshot", "source_set").parquet(f"{sink.rstrip('/')}/epoch={epoch}"))
            if on_batch is not None:
                on_batch(kept, epoch)
        kept.unpersist()
        appended.append(n)

    q = (new_sources(spark, root, repo=repo, snapshot=snapshot).writeStream
         .trigger(availableNow=True).option("checkpointLocation", checkpoint)
         .foreachBatch(handle).start())
    q.awaitTermination()
    return sum(appended)
