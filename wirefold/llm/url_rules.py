"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import lower_ascii, query, table

#: Hex digits of the digest that form the join key.
SHORT = 8


def url_parts(url):
    """(host, path) columns of a url column. Host: after the first ``://`` up to ``/``, ``?``, ``#``
    or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. A null url, or one
    without ``://``, gives two empty strings."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substr(url, cut + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _depth(path):
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _up_to(text, mark, count):
    return F.call_function("substring_index", text, F.lit(mark), count)


def _digest(host, anchor):
    return F.sha2(F.concat(host, anchor), 256)


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, action)`` keyed for the join: each is filed under its host and its path
    up to the last slash. Rules with a null part are left out; repeated rules collapse."""
    host, path = lower_ascii(F.col("host")), F.col("path")
    depth = _depth(path)
    anchor = F.when(depth > 0, F.concat(_up_to(path, "/", depth), F.lit("/"))).otherwise("")
    return (rules.select(host.alias("r_host"), path.alias("r_path"), F.col("action").alias("r_action"),
                         F.size(F.split(host, r"\.", -1)).alias("r_labels"), depth.alias("r_depth"),
                         _digest(host, anchor).alias("r_digest"))
            .dropna().distinct().withColumn("short", F.substring("r_digest", 1, SHORT)))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to rows with a ``url`` column.

    Each distinct (host, path) is expanded into host suffixes x path prefixes at slashes, no deeper
    than the deepest rule (deeper expressions equal no rule's). Expressions meet the rules in an
    equi-join on the first ``SHORT`` hex digits of their SHA-256; the full digest and the rule's
    whole path then confirm. The longest rule (host and path together) wins, then the longer host,
    then ``block``, then the smaller text. Without a rule: ``rule`` is null and the verdict is
    ``default``. Rows, repeated ones included, and other columns are kept (columns named like an
    output are replaced); an empty table gives no rows.
    """
    urls = urls.drop("host", "path", "rule", "verdict")
    host, path = url_parts(F.col("url"))
    rows = urls.withColumn("host", host).withColumn("path", path)
    index = rule_index(rules)
    deep = index.agg(F.coalesce(F.max("r_labels"), F.lit(0)).alias("max_labels"),
                     F.coalesce(F.max("r_depth"), F.lit(0)).alias("max_depth")).first()
    labels = F.split("host", r"\.", -1)
    most = F.least(F.size(labels), F.lit(deep.max_labels))
    suffixes = F.when(most > 0, F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))),
                                            lambda k: _up_to(F.col("host"), ".", -k)))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(_depth(F.col("path")), F.lit(deep.max_depth))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(_up_to(F.col("path"), "/", k), F.lit("/"))))
    expressions = (rows.select("host", "path").distinct()
                   .withColumn("suffix", F.explode(suffixes))
                   .withColumn("prefix", F.explode(prefixes))
                   .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
                   .withColumn("short", F.substring("digest", 1, SHORT)))
    fits = (expressions.join(index, "short").where("digest = r_digest and suffix = r_host")
            .where(F.expr("startswith(path, r_path)")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
        (F.col("r_action") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("verdict"))).alias("best"))
    return (rows.join(best, ["host", "path"], "left")
            .withColumn("rule", F.col("best.rule"))
            .withColumn("verdict", F.coalesce("best.verdict", F.lit(default)))
            .drop("best"))


#: Fixed values of the task: (host, path, action).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op6_url_rules", r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts),
urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(r_host, r_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
         arg_max(action, length(r_host || r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM urls) u
  JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN best USING (host, path)
""")
def op6_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return (judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
            .select("page_id", "host", "path", "rule", "verdict"))
