"""Co-located storage and one-pass status bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators.coverage import status_in_one_pass
from wirefold.plans.colocated import write_colocated_run
from wirefold.plans.registry import query, table


@query("colocated_facts", """
SELECT o_orderkey AS type_id, count(*) AS n_sites, count_if(l_returnflag = 'R') AS n_unresolved, max(l_linenumber) AS last_site
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 GROUP BY o_orderkey""")
def q_colocated_facts(spark, sf_dir):
    """Orders as types and line items as their sites, stored in buckets of the type, read back, joined and
    counted per type: the reading plan has no exchange."""
    types = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("type_id"), "o_totalprice")
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("type_id"), "l_linenumber", "l_returnflag")
    stored = write_colocated_run({"types": types, "sites": sites}, ["type_id"], buckets=16)
    return (stored["types"].where("o_totalprice > 1000").hint("merge").join(stored["sites"], "type_id")
            .groupBy("type_id").agg(F.count("*").alias("n_sites"), F.count_if(F.col("l_returnflag") == "R").alias("n_unresolved"),
                                    F.max("l_linenumber").alias("last_site")))


_SQL_SCOPE = "'r' || CAST({0} % 3 AS VARCHAR) AS repo"


@query("status_one_pass", f"""
WITH l AS (SELECT *, {_SQL_SCOPE.format('l_orderkey')} FROM lineitem), d AS (SELECT *, {_SQL_SCOPE.format('doc_id')} FROM documents)
SELECT repo, 'sites' AS metric, NULL AS reason, count(*) AS n FROM l GROUP BY repo
UNION ALL SELECT repo, 'resolved_sites', NULL, count(*) FROM l WHERE l_returnflag = 'N' GROUP BY repo
UNION ALL SELECT repo, 'unresolved_sites', l_linestatus, count(*) FROM l WHERE l_returnflag <> 'N' GROUP BY repo, l_linestatus
UNION ALL SELECT repo, 'candidates', NULL, CAST(sum(l_linenumber) AS BIGINT) FROM l WHERE l_returnflag = 'A' GROUP BY repo
UNION ALL SELECT repo, 'files', NULL, count(*) FROM d GROUP BY repo
UNION ALL SELECT repo, 'files_by_language', lang, count(*) FROM d GROUP BY repo, lang
UNION ALL SELECT repo, 'parse_failures', source, count(*) FROM d WHERE n_chars > 2000 GROUP BY repo, source""")
def q_status_one_pass(spark, sf_dir):
    """Seven metrics with reasons per repository from two tables, each read once."""
    repo = lambda c: F.concat(F.lit("r"), (F.col(c) % 3).cast("string")).alias("repo")
    yes, none, flag = F.lit(True), F.lit(None), F.col("l_returnflag")
    sites = table(spark, sf_dir, "lineitem").select(repo("l_orderkey"), "l_returnflag", "l_linestatus", "l_linenumber")
    files = table(spark, sf_dir, "documents").select(repo("doc_id"), "lang", "source", "n_chars")
    return status_in_one_pass([
        (sites, [("sites", yes), ("resolved_sites", flag == "N"), ("unresolved_sites", flag != "N", F.col("l_linestatus")),
                 ("candidates", flag == "A", none, F.col("l_linenumber"))]),
        (files, [("files", yes), ("files_by_language", yes, F.col("lang")),
                 ("parse_failures", F.col("n_chars") > 2000, F.col("source"))])], keys=["repo"])
