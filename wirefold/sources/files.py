"""Source-file selection and loading.

Listing and reading are split: a ``binaryFile`` scan that selects only ``path``, ``length`` and
``modificationTime`` never opens the files, so the path rule runs on metadata first and content
is read only for the files it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the selection rule: directory names that are build output.
EXCLUDED_DIR_NAMES = ["node_modules", "build", "target", "out", "bin"]

PRODUCTION, TEST, EXCLUDED = "production", "test", "excluded"


def source_set(rel_path) -> Column:
    """``production`` / ``test`` / ``excluded`` for a path relative to its root.

    Keep ``.java`` only; any directory segment that starts with '.' or is build output excludes
    the file; a directory right after a ``src`` segment whose name contains "test" (any case)
    marks a test source set. The root's own name is not part of the relative path, so a root
    named ``build`` is fine.
    """
    p = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    segs = F.split(p, "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    bad = F.exists(dirs, lambda d: d.startswith(".") | d.isin(EXCLUDED_DIR_NAMES))
    test_pair = F.exists(
        F.transform(dirs, lambda d, i: (i > 0) & (F.element_at(dirs, F.greatest(i, F.lit(1))) == "src")
                    & F.lower(d).contains("test")),
        lambda x: x)
    return (F.when(~p.endswith(".java") | bad, F.lit(EXCLUDED))
            .when(test_pair, F.lit(TEST)).otherwise(F.lit(PRODUCTION)))


def relative_to(path_col: str, root: str) -> Column:
    """Path relative to ``root`` (a URI prefix such as ``file:/data/repo`` or ``s3a://b/r``)."""
    r = root.rstrip("/") + "/"
    return F.when(F.col(path_col).startswith(r),
                  F.substring(F.col(path_col), len(r) + 1, 1 << 30)).otherwise(F.col(path_col))


def list_sources(spark: SparkSession, root: str, *, repo: str, snapshot: str) -> DataFrame:
    """Every file under ``root`` with its fingerprint and source set; file contents are not read."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(root).select("path", "length", "modificationTime"))
    rel = relative_to("path", _as_uri(spark, root))
    return listing.select(
        F.lit(repo).alias("repo"), F.lit(snapshot).alias("snapshot"),
        F.col("path").alias("uri"), rel.alias("path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), source_set(rel).alias("source_set"))


def _as_uri(spark: SparkSession, root: str) -> str:
    if "://" in root or root.startswith("file:"):
        return root
    return "file:" + root


def text_of(content) -> Column:
    """UTF-8 text of file bytes; malformed bytes become U+FFFD, so one file never fails a job."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def read_sources(spark: SparkSession, root: str, *, repo: str, snapshot: str, keep=(PRODUCTION, TEST)) -> DataFrame:
    """``list_sources`` with the content of the kept files, through Spark's own ``binaryFile``
    reader, so every store that Spark reads works. Only ``.java`` files are opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.java").load(root))
    rel = relative_to("path", _as_uri(spark, root))
    return (files.select(
        F.lit(repo).alias("repo"), F.lit(snapshot).alias("snapshot"),
        F.col("path").alias("uri"), rel.alias("path"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), source_set(rel).alias("source_set"),
        text_of("content").alias("content"))
        .where(F.col("source_set").isin(list(keep))))
