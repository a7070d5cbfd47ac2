"""Fingerprints of folder trees, and a diff that goes down into changed folders only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.operators.snapshots import row_hash
from wirefold.session import cut_lineage

_SUMS = ["n_files", "high", "low"]


def _parent(path: str) -> Column:
    """Folder of a path; the root is the empty path, whose folder is null."""
    return F.when(F.col(path) == "", None).when(F.instr(path, "/") == 0, F.lit("")).otherwise(
        F.regexp_replace(path, "/[^/]*$", ""))


def fingerprint_tree(files: DataFrame, *, path: str, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per file and per folder up to the root: ``keys, path, parent, is_file, depth, n_files,
    high, low``.

    A node's fingerprint is its number of files and the sums of both halves of their 128-bit hashes
    (of path and ``fields``). Sums add up, so a folder is the sum of its children: each depth is one
    grouped sum of the depth below, partial in every task, and a folder with a third of all files is
    not gathered. Null paths are left out; equal rows of a path count as often as they are there."""
    keys = list(keys)
    high, low = row_hash([path, *fields])
    rows = files.where(F.col(path).isNotNull()).select(*keys, F.col(path).alias("path"), high.alias("high"), low.alias("low"))
    leaves = (rows.groupBy(*keys, "path").agg(F.count("*").alias("n_files"), F.sum("high").alias("high"), F.sum("low").alias("low"))
              .withColumn("is_file", F.lit(True))
              .withColumn("depth", F.size(F.split("path", "/")).cast("long")).withColumn("parent", _parent("path")))
    order = [*keys, "path", "parent", "is_file", "depth", *_SUMS]
    leaves = cut_lineage(leaves.select(*order))
    tree = level = leaves
    for depth in range((leaves.agg(F.max("depth")).first()[0] or 0) - 1, -1, -1):
        below = level.where(F.col("depth") == depth + 1)
        folders = (below.groupBy(*keys, F.col("parent").alias("path")).agg(*[F.sum(c).alias(c) for c in _SUMS])
                   .withColumn("is_file", F.lit(False)).withColumn("depth", F.lit(depth).cast("long"))
                   .withColumn("parent", _parent("path")).select(*order))
        folders = cut_lineage(folders)
        tree = tree.unionByName(folders)
        level = leaves.where(F.col("depth") == depth).unionByName(folders)
    return tree


def tree_diff(old: DataFrame, new: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest subtrees that cover all changes between two ``fingerprint_tree``s: ``keys, path,
    is_file, change, n_files`` (files of the new state, of the old one where deleted).

    From the root down, the children of changed folders alone are compared: equal fingerprints end
    there, a folder that only one side has is reported as a whole, one that both have differently
    is entered. The work follows the changed folders, not the files. A file in the place of a folder
    is a deletion and an addition. Equal trees give no rows.
    """
    keys = list(keys)
    node = [*keys, "path", "is_file"]
    print_of = F.struct(*_SUMS)
    front, found = None, None
    while True:
        sides = []
        for tree in (old, new):
            part = (tree.where("depth = 0") if front is None else
                    tree.join(front.select(*keys, F.col("path").alias("parent")), [*keys, "parent"], "left_semi"))
            sides.append(part.select(*node, print_of.alias("p")))
        both = sides[0].withColumnRenamed("p", "o").join(sides[1].withColumnRenamed("p", "n"), node, "full_outer")
        change = (F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("modified"))
        level = cut_lineage(both.where(F.col("o").isNull() | F.col("n").isNull() | (F.col("o") != F.col("n")))
                            .select(*node, change.alias("change"), F.coalesce("n.n_files", "o.n_files").alias("n_files")))
        entered = (F.col("change") == "modified") & ~F.col("is_file")
        told = level.where(~entered)
        found = told if found is None else found.unionByName(told)
        front = level.where(entered)
        if front.isEmpty():
            return found
