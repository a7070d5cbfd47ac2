"""Folder trees bound to the driver tables: a document is a file ``b<doc_id / 20>/<lang>/Doc<doc_id>``.

The old state lacks every tenth batch and the French folder of batches that leave 1 by 7; the new one
lacks every thirteenth batch and has other times for the even documents of every seventh."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators.trees import fingerprint_tree, tree_diff
from wirefold.plans.registry import query, table


def _files(spark, sf_dir, old: bool):
    batch = F.floor(F.col("doc_id") / 20)
    path = F.concat(F.lit("b"), batch.cast("string"), F.lit("/"), "lang", F.lit("/Doc"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", batch.alias("batch"), path.alias("path"),
                                                 F.col("n_chars").alias("size"))
    if old:
        return (d.where((F.col("batch") % 10 != 0) & ~((F.col("batch") % 7 == 1) & (F.col("lang") == "fr")))
                .withColumn("mtime", F.lit(0)))
    changed = (F.col("batch") % 7 == 0) & (F.col("doc_id") % 2 == 0)
    return d.where(F.col("batch") % 13 != 0).withColumn("mtime", F.when(changed, 1).otherwise(0))


@query("tree_diff", """
WITH d AS (SELECT doc_id, lang, doc_id // 20 AS b, 'b' || CAST(doc_id // 20 AS VARCHAR) AS dir FROM documents),
f AS (SELECT d.*, dir || '/' || lang AS sub, dir || '/' || lang || '/Doc' || CAST(doc_id AS VARCHAR) AS path,
             b % 10 <> 0 AND NOT (b % 7 = 1 AND lang = 'fr') AS o, b % 13 <> 0 AS n,
             b % 7 = 0 AND doc_id % 2 = 0 AS touched FROM d),
dirs AS (SELECT dir, bool_or(o) AS o, bool_or(n) AS n, count_if(o) AS no, count_if(n) AS nn FROM f GROUP BY dir),
subs AS (SELECT dir, sub, bool_or(o) AS o, bool_or(n) AS n, count_if(o) AS no, count_if(n) AS nn FROM f GROUP BY dir, sub)
SELECT dir AS path, false AS is_file, CASE WHEN n THEN 'added' ELSE 'deleted' END AS change,
       CAST(CASE WHEN n THEN nn ELSE no END AS BIGINT) AS n_files FROM dirs WHERE o <> n
UNION ALL
SELECT sub, false, CASE WHEN s.n THEN 'added' ELSE 'deleted' END, CASE WHEN s.n THEN s.nn ELSE s.no END
FROM subs s JOIN dirs USING (dir) WHERE dirs.o AND dirs.n AND s.o <> s.n
UNION ALL
SELECT path, true, 'modified', 1 FROM f JOIN subs USING (sub) WHERE subs.o AND subs.n AND f.o AND f.n AND touched""")
def q_tree_diff(spark, sf_dir):
    """The smallest changed subtrees between two states of the documents' folders."""
    old, new = (fingerprint_tree(_files(spark, sf_dir, old), path="path", fields=["size", "mtime"]) for old in (True, False))
    return tree_diff(old, new)
