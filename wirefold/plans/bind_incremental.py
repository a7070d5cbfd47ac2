"""Incremental answers bound to the driver tables.

The new state is the tables themselves: suppliers are candidates in files of ten, customers sites
in files of twenty (see ``bind_candidates``). The old state differs in the files whose number leaves
3 by 7 (suppliers) or 5 by 11 (customers): there every fourth supplier did not exist yet, others had
the balance of opposite sign, some stood in the next run; customers had another qualifier, and every
sixth did not exist. Files that leave 6 by 7 were saved again without a change.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import candidates as C
from wirefold.operators import incremental as I
from wirefold.plans import bind_candidates as B
from wirefold.plans.registry import query, table


def _contract_of(nation, key, shift=0):
    return F.concat_ws(".", F.col(nation).cast("string"), (F.floor(F.col(key) / B.PER_RUN) + shift).cast("string"))


def candidate_rows(spark, sf_dir, old: bool):
    s = table(spark, sf_dir, "supplier")
    file = F.floor(F.col("s_suppkey") / 10)
    changed = file % 7 == 3
    bal, shift = F.col("s_acctbal"), F.lit(0)
    if old:
        s = s.where(~changed | (F.col("s_suppkey") % 4 != 0))
        bal = F.when(changed, -bal).otherwise(bal)
        shift = F.when(changed & (F.col("s_suppkey") % 5 == 1), F.lit(1)).otherwise(F.lit(0))
    return s.select(file.alias("file"), "s_suppkey", "s_name", _contract_of("s_nationkey", "s_suppkey", shift).alias("contract"),
                    (bal > 9000).alias("is_primary"), (bal < 0).alias("is_conditional"))


def site_rows(spark, sf_dir, old: bool):
    file = F.floor(F.col("c_custkey") / 20)
    s = B._sites(spark, sf_dir).withColumn("file", file)
    changed = F.col("file") % 11 == 5
    if old:
        s = (s.where(~changed | (F.col("c_custkey") % 6 != 0))
             .withColumn("qualifier", F.when(changed, F.lit(None).cast("string")).otherwise(F.col("qualifier"))))
    return s.select("file", "c_custkey", "contract", "c_mktsegment", "qualifier")


def listing(rows, saved):
    """Files with the time they were saved: changed ones, and some without a change, saved again."""
    return rows.select("file").distinct().withColumn("mtime", saved)


def resolve(sites, candidates):
    return C.resolve_candidate(sites.drop("file"), candidates, contract="contract", qualifier="qualifier",
                               cand_contract="contract", cand_id="s_suppkey", cand_name="s_name",
                               cand_order="s_suppkey", primary="is_primary", conditional="is_conditional")


def refreshed(spark, sf_dir):
    """Edges of the old state, deltas of the changed files, and the edges after them."""
    old_sites, new_sites = (site_rows(spark, sf_dir, old) for old in (True, False))
    old_cands, new_cands = (candidate_rows(spark, sf_dir, old) for old in (True, False))
    old_edges = resolve(old_sites, old_cands)
    changed, again = F.col("file") % 7 == 3, F.col("file") % 7 == 6
    c_files = I.changed_files(listing(old_cands, F.lit(1)), listing(new_cands, F.when(changed | again, 2).otherwise(1)),
                              key=["file"], fingerprint=["mtime"])
    s_files = I.changed_files(listing(old_sites, F.lit(1)), listing(new_sites, F.when(F.col("file") % 11 == 5, 2).otherwise(1)),
                              key=["file"], fingerprint=["mtime"])
    d_cands = I.fact_delta(old_cands, new_cands, c_files, file=["file"])
    d_sites = I.fact_delta(old_sites, new_sites, s_files, file=["file"])
    after = I.refresh_lookups(old_edges, new_sites, new_cands, d_sites, [("contract", d_cands.select("contract"))],
                              site_key=["c_custkey"], target_key="contract", resolve=resolve)
    return old_edges, after


_FULL = B._sql_candidate(False)
_SQL_TOUCHED = f"""
WITH {B._SQL_SITES},
n AS (SELECT s_suppkey, s_suppkey // 10 % 7 = 3 AS changed, s_acctbal,
             CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey // 50 AS VARCHAR) AS contract,
             CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey // 50 + 1 AS VARCHAR) AS next FROM supplier),
touched AS (
  SELECT contract FROM n WHERE changed AND (s_suppkey % 4 = 0 OR s_suppkey % 5 = 1
      OR (s_acctbal > 9000) <> (-s_acctbal > 9000) OR (s_acctbal < 0) <> (-s_acctbal < 0))
  UNION SELECT next FROM n WHERE changed AND s_suppkey % 4 <> 0 AND s_suppkey % 5 = 1),
own AS (SELECT c_custkey FROM customer WHERE c_custkey // 20 % 11 = 5 AND (c_custkey % 6 = 0 OR c_mktsegment = 'BUILDING')),
redone AS (SELECT c_custkey FROM site WHERE contract IN (SELECT contract FROM touched) UNION SELECT c_custkey FROM own)"""


@query("incremental_edges", f"""
{_SQL_TOUCHED}
SELECT e.*, r.c_custkey IS NOT NULL AS redone FROM ({_FULL}) e LEFT JOIN redone r USING (c_custkey)""")
def q_incremental_edges(spark, sf_dir):
    """Edges after the diff, refreshed from the old ones: equal to a full rebuild; ``redone`` marks the
    sites worked out again, which are those that the delta touches."""
    _, after = refreshed(spark, sf_dir)
    again = after.upserts.select("c_custkey").withColumn("redone", F.lit(True))
    return after.rows.join(again, "c_custkey", "left").withColumn("redone", F.coalesce("redone", F.lit(False)))


@query("incremental_reasons", f"""
SELECT coalesce(reason, kind) AS outcome, count(*) AS n, CAST(sum(n_candidates) AS BIGINT) AS n_candidates
FROM ({_FULL}) GROUP BY 1""")
def q_incremental_reasons(spark, sf_dir):
    """Sites and candidates by outcome, kept by adding the weights of edges that left and came."""
    old, after = refreshed(spark, sf_dir)
    shape = lambda e: e.select(F.coalesce("reason", "kind").alias("outcome"), "n_candidates")
    before = shape(old).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("n_candidates"))
    delta = I.signed(shape(old.join(after.gone, "c_custkey", "left_semi")), shape(after.upserts))
    return I.refresh_sums(before, delta, keys=["outcome"], count="n", sums=["n_candidates"])


@query("incremental_join", f"""
WITH {B._SQL_SITES},
s AS ({B._SQL_SUPPLIERS}),
qualified AS (SELECT c_custkey, contract, CASE WHEN c_mktsegment = 'BUILDING'
                THEN 'Supplier#' || lpad(CAST(run * 50 + c_custkey % 50 AS VARCHAR), 9, '0') END AS qualifier FROM site)
SELECT contract, count(*) AS n_pairs, count(qualifier) AS n_qualified
FROM qualified JOIN s ON s.s_contract = contract GROUP BY contract""")
def q_incremental_join(spark, sf_dir):
    """Pairs of site and candidate per contract: the join's delta meets an additive aggregate."""
    sites = [site_rows(spark, sf_dir, old).select("contract", "c_custkey", "qualifier") for old in (True, False)]
    cands = [candidate_rows(spark, sf_dir, old).select("contract", "s_suppkey") for old in (True, False)]
    value = F.col("qualifier").isNotNull().cast("long").alias("n_qualified")
    before = (sites[0].join(cands[0], "contract").groupBy("contract")
              .agg(F.count("*").alias("n_pairs"), F.count("qualifier").alias("n_qualified")))
    delta = I.join_delta(sites[0], I.signed(*sites), cands[0], I.signed(*cands), ["contract"])
    return I.refresh_sums(before, delta.select("contract", value, I.WEIGHT), keys=["contract"], count="n_pairs",
                          sums=["n_qualified"])
