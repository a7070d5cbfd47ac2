"""Helpers shared by the corpus operators: registry, stored intermediates, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: One word: a run of anything but ASCII white space (same pattern in Java, Python and DuckDB).
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Texts that go to a Python worker at a time.
TEXTS_PER_BATCH = 1_000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were brought down to ``TEXTS_PER_BATCH`` rows: a
    worker and its executor hold a few MB of texts at a time, long ones included."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS_PER_BATCH:
        conf.set(key, TEXTS_PER_BATCH)
    return df


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """In a worker: ``name`` keeps a table between tasks that ``clear`` empties."""
    _held[name] = clear


def release() -> None:
    """In a worker: empty what other operators' tasks kept, before work that needs the memory."""
    while _held:
        _held.popitem()[1]()


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into a new folder under the shared checkpoint folder and read it
    back: the lineage is cut and every executor can read the rows again after a loss."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a stored frame that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find: ``links(a, b)`` of longs -> ``(node, component)``.

    ``component`` is the smallest node reachable. Alternating large-star and small-star rounds
    re-point every node at the smallest neighbour it knows; both halves are grouped minima and an
    equi-join back, so no neighbour list is ever gathered. Each round is stored, so a lost
    executor costs one round. Null ends and self links are ignored; an empty input gives no rows.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct())
    state = _edge_state(edges)
    while state[0]:
        # large star: every neighbour above u is hung under the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, are hung under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        after = store(small.where("u <> v").distinct())
        now = _edge_state(after)
        drop_stored(edges)
        edges = after
        if now == state:
            break
        state = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v"), F.col("v"))).distinct())


def _edge_state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])
