"""Fact tables stored in buckets of their join key, so that joins and sums over it need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from wirefold.session import ensure_checkpoint_dir


def write_colocated(df: DataFrame, name: str, by: Sequence[str], *, buckets: int, path: str) -> DataFrame:
    """Store ``df`` as table ``name`` under ``path``, in ``buckets`` buckets of ``by``, sorted by ``by``;
    returns the stored table. A table of that name is replaced.

    Tables with the same ``by`` and number of buckets join and group on ``by`` with neither a shuffle nor a
    sort: pay once on writing what each reader would pay. One shuffle deals the rows, so that a
    bucket is one file. Take as ``by`` an id of a declaration or file and not a scope alone: a bucket is
    read by one task. Null ids share a bucket; an empty table keeps its columns.
    """
    by = list(by)
    (df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by)
     .option("path", f"{path.rstrip('/')}/{name}").saveAsTable(name))
    return df.sparkSession.table(name)


def write_colocated_run(tables: dict[str, DataFrame], by: Sequence[str], *, buckets: int) -> dict[str, DataFrame]:
    """Store several tables of one run in a folder of their own under the shared checkpoint folder."""
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    folder = f"{ensure_checkpoint_dir(spark)}/colocated-{run}"
    return {n: write_colocated(df, f"{n}_{run}", by, buckets=buckets, path=folder) for n, df in tables.items()}
