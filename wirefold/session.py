"""Spark session and cluster-wide settings used by every job.

The library never creates machine-local scratch space on a cluster: lineage is cut with
``checkpoint()`` into the shared folder named by ``spark.checkpoint.dir``. Only a local-mode
session without that setting (tests, laptops) gets a fresh folder under /tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.driver.memory": "8g",  # only takes effect when this call starts the JVM (local mode)
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A level's checkpoint goes when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Fact tables are written partitioned by (repo, snapshot); re-running one snapshot must
    # replace only its own partitions.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def _export_package_path() -> str:
    """Python workers must import this package (``extract_facts`` runs in them). Locally they
    inherit PYTHONPATH; on a cluster ship the package with ``--py-files``."""
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    current = os.environ.get("PYTHONPATH", "")
    if parent not in current.split(os.pathsep):
        os.environ["PYTHONPATH"] = parent + (os.pathsep + current if current else "")
    return parent


def get_session(master: str | None = None, app: str = "wirefold",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    parent = _export_package_path()
    builder = SparkSession.builder.appName(app).config("spark.executorEnv.PYTHONPATH", parent)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the folder it writes to.

    Order: an already-set context dir, then ``spark.checkpoint.dir`` from the session, then
    (local mode only) a new folder under /tmp. On a cluster without the setting we refuse
    rather than write to an executor-local disk that disappears with the executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="wirefold-ckpt-", dir=os.environ.get("WIREFOLD_TMP", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before running "
                       "iterative operators on a cluster")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet beside the checkpoints: for wide or long frames, which a checkpoint
    writes uncompressed, row by row. Partitioning is not kept."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
