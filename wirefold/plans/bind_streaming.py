"""The arrival stream bound to the driver tables: documents land as source files in three parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wirefold.plans.bind_lifecycle import _SQL_DOC_PATHS, _doc_paths
from wirefold.plans.registry import query
from wirefold.session import ensure_checkpoint_dir
from wirefold.sources.files import source_set
from wirefold.streaming.arrivals import delivered, stream_arrivals, uncommit

PARTS = 3


@query("stream_new_sources", f"""
WITH {_SQL_DOC_PATHS}
SELECT doc_id, path, source_set, CAST(doc_id % {PARTS} AS BIGINT) AS part, CAST(1 AS BIGINT) AS deliveries
FROM c WHERE source_set <> 'excluded'""")
def q_stream_new_sources(spark, sf_dir):
    """Kept files as a stream delivers them: a run after each part has landed, the second and the last
    epoch run twice as after a lost driver, and a run without arrivals."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    landing, sink, state = (f"{base}/{x}" for x in ("landing", "sink", "state"))
    docs = _doc_paths(spark, sf_dir).select("doc_id", "path")
    schema = docs.schema

    def keep(df):
        return df.withColumn("source_set", source_set("path")).where("source_set <> 'excluded'")

    for part in range(PARTS):
        docs.where(F.col("doc_id") % PARTS == part).write.mode("append").parquet(landing)
        stream_arrivals(spark, landing, schema, sink=sink, checkpoint=state, keep=keep)
        if part:
            uncommit(spark, state)
            stream_arrivals(spark, landing, schema, sink=sink, checkpoint=state, keep=keep)
    stream_arrivals(spark, landing, schema, sink=sink, checkpoint=state, keep=keep)
    rows = delivered(spark, sink, keep(docs).schema)
    return (rows.groupBy("doc_id", "path", "source_set").agg(F.count("*").alias("deliveries"))
            .select("doc_id", "path", "source_set", (F.col("doc_id") % PARTS).alias("part"), "deliveries"))
