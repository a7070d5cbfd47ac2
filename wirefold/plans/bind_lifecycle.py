"""Source selection, parsing, freshness, refs and retention bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import snapshots as S
from wirefold.plans.registry import query, table
from wirefold.sources.files import source_set
from wirefold.sources.text import parse_quarantine

# Fixed values of the binding: directories by doc_id % 6.
DOC_DIRS = ["src/main", "src/test", "build", ".cache", "src/integrationTest", "test/src"]


def _doc_paths(spark, sf_dir):
    dirs = F.array(*[F.lit(d) for d in DOC_DIRS])
    d = F.element_at(dirs, (F.col("doc_id") % 6 + 1).cast("int"))
    ext = F.when(F.col("doc_id") % 5 == 0, F.lit(".kt")).otherwise(F.lit(".java"))
    path = F.concat(d, F.lit("/"), F.col("lang"), F.lit("/Doc"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select("doc_id", "source", path.alias("path"))


_SQL_DOC_PATHS = """
p AS (SELECT doc_id, source,
        ['src/main','src/test','build','.cache','src/integrationTest','test/src'][(doc_id % 6) + 1]
        || '/' || lang || '/Doc' || CAST(doc_id AS VARCHAR)
        || CASE WHEN doc_id % 5 = 0 THEN '.kt' ELSE '.java' END AS path FROM documents),
d AS (SELECT p.*, string_split(path, '/') AS segs FROM p),
c AS (SELECT doc_id, source, path,
        CASE WHEN NOT ends_with(path, '.java')
               OR len(list_filter(segs[1:len(segs)-1], lambda s: starts_with(s, '.')
                      OR s IN ('node_modules', 'build', 'target', 'out', 'bin'))) > 0 THEN 'excluded'
             WHEN len(list_filter(range(2, len(segs)), lambda i: segs[i-1] = 'src'
                      AND contains(lower(segs[i]), 'test'))) > 0 THEN 'test'
             ELSE 'production' END AS source_set FROM d)"""


@query("select_sources", f"WITH {_SQL_DOC_PATHS} SELECT doc_id, source, path FROM c WHERE source_set = 'production'")
def q_select_sources(spark, sf_dir):
    """Production .java files: no hidden or build-output directory, not under src/<test...>."""
    p = _doc_paths(spark, sf_dir)
    return p.where(source_set("path") == "production")


@query("select_test_sources", f"WITH {_SQL_DOC_PATHS} SELECT doc_id, source, path FROM c WHERE source_set = 'test'")
def q_select_test_sources(spark, sf_dir):
    """Test .java files: same exclusions, and under a src/<...test...> source set."""
    p = _doc_paths(spark, sf_dir)
    return p.where(source_set("path") == "test")


@query("parse_quarantine", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, length(props) - 1)
                                 ELSE props END AS payload FROM events)
SELECT event_id,
  CASE WHEN json_valid(payload) THEN CAST(json_extract(payload, '$.k') AS BIGINT) END AS k,
  CASE WHEN json_valid(payload) THEN 'parsed' ELSE 'rejected' END AS status,
  CASE WHEN NOT json_valid(payload) THEN 'malformed: ' || split_part(payload, chr(10), 1) END AS reason
FROM e""")
def q_parse_quarantine(spark, sf_dir):
    """Event payloads, one in eleven truncated: parsed rows give k, the rest a reason."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 11 == 0,
                           F.expr("substring(props, 1, length(props) - 1)"))
        .otherwise(F.col("props")).alias("payload"))
    good, bad = parse_quarantine(ev, row_id="event_id", payload="payload", schema="k long")
    return (good.select("event_id", "k", F.lit("parsed").alias("status"),
                        F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select("event_id", F.lit(None).cast("long").alias("k"),
                                    F.lit("rejected").alias("status"), "reason")))


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    old = d.where(F.col("doc_id") % 10 != 0).select(
        F.col("doc_id").alias("path"), "source", F.col("n_chars").alias("size"),
        F.lit(0).cast("long").alias("mtime"))
    new = d.where(F.col("doc_id") % 13 != 0).select(
        F.col("doc_id").alias("path"), "source", F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("mtime"))
    return old, new


_SQL_VERSIONS = """
o AS (SELECT doc_id AS path, source, n_chars AS size, CAST(0 AS BIGINT) AS mtime FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id AS path, source, n_chars AS size,
        CAST(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS mtime FROM documents WHERE doc_id % 13 <> 0)"""


@query("snapshot_diff", f"""WITH {_SQL_VERSIONS}
SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
       WHEN o.size IS DISTINCT FROM n.size OR o.mtime IS DISTINCT FROM n.mtime THEN 'modified'
       ELSE 'unchanged' END AS change
FROM o FULL OUTER JOIN n ON o.path = n.path""")
def q_snapshot_diff(spark, sf_dir):
    """Two versions of the document set compared on (size, mtime): added/deleted/modified/unchanged."""
    old, new = _versions(spark, sf_dir)
    return S.snapshot_diff(old, new, key=["path"], fingerprint=["size", "mtime"])


@query("snapshot_fingerprint", f"""WITH {_SQL_VERSIONS},
v AS (SELECT 'old' AS version, * FROM o UNION ALL SELECT 'new', * FROM n),
h AS (SELECT version, source, md5(CAST(path AS VARCHAR) || '|' || CAST(size AS VARCHAR) || '|'
      || CAST(mtime AS VARCHAR)) AS m FROM v)
SELECT version, source, count(*) AS n_files,
  CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(CAST('0x' || substr(m, 1, 16) AS UBIGINT) AS DECIMAL(38,0))) AS VARCHAR)
    || ':' || CAST(sum(CAST(CAST('0x' || substr(m, 17, 16) AS UBIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS fingerprint
FROM h GROUP BY version, source""")
def q_snapshot_fingerprint(spark, sf_dir):
    """Order-independent fingerprint of each version's files per source."""
    old, new = _versions(spark, sf_dir)
    v = (old.withColumn("version", F.lit("old"))
         .unionByName(new.withColumn("version", F.lit("new"))))
    return S.snapshot_fingerprint(v, group=["version", "source"], fields=["path", "size", "mtime"])


@query("ref_asof", """
WITH err AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
pur AS (SELECT event_id AS purchase_id, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
m AS (SELECT err.event_id, pur.purchase_id FROM err JOIN pur ON pur.user_id = err.user_id AND pur.pts <= err.ts
      QUALIFY row_number() OVER (PARTITION BY err.event_id ORDER BY pur.pts DESC, pur.purchase_id DESC) = 1)
SELECT err.event_id, err.user_id, m.purchase_id, m.purchase_id IS NOT NULL AS matched
FROM err LEFT JOIN m ON m.event_id = err.event_id""")
def q_ref_asof(spark, sf_dir):
    """Each error event -> the user's latest purchase at or before it (as-of join)."""
    ev = table(spark, sf_dir, "events")
    err = ev.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    pur = ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), "user_id", "ts")
    out = S.asof_join(err, pur, key=["user_id"], left_ts="ts", right_ts="ts", left_id="event_id",
                      right_cols=["purchase_id"], right_order="purchase_id")
    return out.select("event_id", "user_id", "purchase_id", "matched")


@query("retain_generations", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS generation
FROM events QUALIFY generation <= 5""")
def q_retain_generations(spark, sf_dir):
    """The newest five events per user are kept."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = S.retain_generations(ev, group=["user_id"], recency=[F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_id", "generation")


@query("root_kind", """
SELECT doc_id, source, CASE WHEN source = 'src0' THEN 'default'
                            WHEN source = 'src1' THEN 'ref' ELSE 'root' END AS root_kind
FROM documents""")
def q_root_kind(spark, sf_dir):
    """Document sources as roots: src0 is the default root, src1 is the refs base or has roots
    below it; src10 to src19 only share its first letters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    root = F.when((F.col("source") == "src0") | (F.col("lang") == "en"), F.col("source")).otherwise(
        F.concat_ws("/", "source", "lang"))
    return d.select("doc_id", "source", S.root_kind(root, default="src0", refs_base="src1").alias("root_kind"))
