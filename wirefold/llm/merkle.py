"""Merkle manifest of a dataset: levels of aligned blocks as concatenated hex strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import query, store, table
from wirefold.operators.ranks import numbered

#: Children of a node; levels that a pass lifts within a block; leaves of a block; length of a digest.
FAN, LEVELS, HEX = 3, 5, 64
BLOCK = FAN ** LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A source as a key without nulls that sorts as sources do: the null one first, others by bytes.
KEYS = ["_known", "_name"]


def field(value: Column) -> Column:
    """One value of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in columns.values()])


def _lift(nodes: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One pass: ``nodes(keys, position, total, hash, carry)`` -> a row per aligned block of
    ``BLOCK`` nodes with its ``members`` in order, ``level0`` (their digests as one string),
    ``level1`` .. (each hashed from fixed-width substrings of the one below) and ``top``.

    A level that does not exist is null: a tree of one block ends where one node is left; blocks
    of a larger tree are lifted by ``LEVELS`` levels, short last ones too."""
    blocks = (nodes.groupBy(*keys, "total", F.expr(f"position div {BLOCK}").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("position", "hash", *carry))).alias("members"))
              .withColumn("level0", F.expr("array_join(transform(members, m -> m.hash), '')")))
    wide = FAN * HEX
    for i in range(LEVELS):
        blocks = blocks.withColumn(f"level{i + 1}", F.expr(f"""
            CASE WHEN total > {BLOCK} OR length(level{i}) > {HEX} THEN array_join(transform(
              sequence(0, (length(level{i}) - 1) div {wide}),
              j -> sha2(cast(substring(level{i}, cast(j * {wide} + 1 as int), {wide}) as binary), 256)), '') END"""))
    return blocks.withColumn("top", F.coalesce(*[F.col(f"level{i}") for i in range(LEVELS, -1, -1)]))


def _passes(nodes: DataFrame, keys: list[str], carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Lift until every tree has one node: the blocks of each pass, and ``(keys, hash)`` of the roots."""
    passes, roots = [], None
    while True:
        blocks = store(_lift(nodes, keys, carry))
        passes.append(blocks)
        done = blocks.where(f"total <= {BLOCK}").select(*keys, F.col("top").alias("hash"))
        roots = done if roots is None else roots.union(done)
        rest = blocks.where(f"total > {BLOCK}")
        if rest.isEmpty():
            return passes, roots
        carry = []
        nodes = rest.select(*keys, F.col("block").alias("position"),
                            F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("top").alias("hash"))


def _siblings(i: int) -> Column:
    """What flanks member ``_at`` of a block in its run at level ``i``; null above the tree's top."""
    node = f"(_at div {FAN ** i})"
    run = f"substring(level{i}, cast({node} div {FAN} * {FAN * HEX} + 1 as int), {FAN * HEX})"
    return F.expr(f"""CASE WHEN level{i + 1} IS NOT NULL THEN named_struct(
        'l', substring({run}, 1, cast({node} % {FAN} * {HEX} as int)),
        'r', substring({run}, cast(({node} % {FAN} + 1) * {HEX} + 1 as int))) END""")


def _paths(passes: list[DataFrame], keys: list[str], roots: DataFrame | None, carried: list[str]) -> DataFrame:
    """``(keys, position, path, carried, members' columns)`` of the first pass's nodes. ``roots`` has
    the path above each tree's root and what all its nodes carry down; None: nothing is above. From the last pass to the
    first, a block takes the path of its top and deals it out, one more stretch in front."""
    below = None
    for blocks in reversed(passes):
        ends = (blocks.where(f"total <= {BLOCK}").select(*keys, F.lit(0).cast("long").alias("block")))
        above = (ends.join(roots, keys) if keys else ends.withColumn("path", F.expr(_NO_PATH))
                 ).select(*keys, "block", "path", *carried)
        if below is not None:
            above = above.union(below.select(*keys, F.col("position").alias("block"), "path", *carried))
        here = blocks.join(above, [*keys, "block"]).select("*", F.posexplode("members").alias("_at", "_m"))
        own = F.array_compact(F.array(*[_siblings(i) for i in range(LEVELS)]))
        below = here.select(*keys, *carried, "_m.*", F.concat(own, "path").alias("path"))
    return below


_NO_PATH = "cast(array() as array<struct<l:string,r:string>>)"


@dataclass
class Manifest:
    """``root``: digest of the dataset (None for an empty one); ``subroots``: source, subroot;
    ``proofs``: a row per leaf with its carried columns, leaf, subroot and ``path``, the siblings
    ``(l, r)`` of each run from the leaf up to the root."""

    root: str | None
    subroots: DataFrame
    proofs: DataFrame


def build(leaves: DataFrame, source: str, order: str, carry: list[str]) -> Manifest:
    """Manifest over ``leaves`` (column ``leaf``, 64 hex digits): per source a tree over its leaves by
    ``order``, then a tree over the sources.

    1. Leaves get their number within their source by ranges of (source, order, leaf) and prefix
       sums, so a source with a third of all rows is nobody's single task.
    2. A pass gathers aligned blocks of 243 leaves; each level of a block is one string of hex
       digits, whose fixed-width substrings hash to the next. Block tops are the next pass's nodes.
    3. Proofs go down the same passes: flanking substrings are a node's siblings.

    Null sources form one source, sorted first; null order values come first; equal leaves of one
    place are interchangeable. Work is linear, with log_243 of the largest source's rows as passes.
    """
    spark = leaves.sparkSession
    rows = leaves.select(F.col(source).isNotNull().alias("_known"), F.coalesce(F.col(source), F.lit("")).alias("_name"),
                         F.col(order).alias("_order"), F.col("leaf").alias("hash"), *carry)
    rows = store(rows)  # sampling for the ranges reads digests, not texts
    places = numbered(rows, KEYS, ["_order", "hash"], total="total").drop("_order")
    passes, subroots = _passes(places, KEYS, carry)
    subroots = store(subroots)
    n = subroots.count()
    names = subroots.select(*KEYS, F.when(F.col("_known"), F.col("_name")).alias(source), F.col("hash").alias("subroot"))
    if not n:
        empty = spark.createDataFrame([], rows.select(*KEYS, *carry, F.col("hash").alias("leaf"), F.col("hash").alias("subroot"),
                                                      F.expr(_NO_PATH).alias("path")).schema)
        return Manifest(None, names.drop(*KEYS), empty.drop(*KEYS))
    upper = numbered(subroots, [], KEYS).withColumn("total", F.lit(n).cast("long"))
    tops, end = _passes(upper, [], KEYS)
    root = end.first()["hash"]
    ends = _paths(tops, [], None, []).select(*KEYS, "path", F.col("hash").alias("subroot"))
    proofs = _paths(passes, KEYS, store(ends), ["subroot"])
    return Manifest(root, names.drop(*KEYS),
                    proofs.select(*carry, F.col("hash").alias("leaf"), "subroot", "path"))


def fold(start: Column, path: Column) -> Column:
    """Digest of the root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: digest(s["l"], h, s["r"]))


def proof(path: Column) -> Column:
    """All siblings of a path, from left to right and from the leaf up, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def audit(docs: DataFrame, altered: dict[str, Column], columns: tuple = COLUMNS, source: str = "source",
          order: str = "doc_id") -> DataFrame:
    """Manifest of ``docs`` held against a copy in which ``altered`` columns have new values: per row
    ``order`` column, ``leaf``, ``subroot``, ``root``, ``path``, ``folded_root`` (from the copy's leaf and
    the original siblings) and ``verified`` (the fold gives the root).

    A leaf covers ``columns`` in their order; nulls, empty and long values count as they are; rows
    that are equal in all of them have equal leaves. An empty table gives no rows. Other columns
    play no part. The text is read once; only digests are shuffled."""
    taken = docs.select(F.col(source).alias("_source"), F.col(order).alias("_id"),
                        leaf({c: docs[c] for c in columns}).alias("leaf"),
                        leaf({c: altered.get(c, docs[c]) for c in columns}).alias("_copy"))
    taken = taken.withColumn("_copy", F.when(F.col("_copy") != F.col("leaf"), F.col("_copy")))
    m = build(taken, "_source", "_id", ["_id", "_copy"])
    folded = m.proofs.withColumn("folded_root", fold(F.coalesce("_copy", "leaf"), F.col("path")))
    root = F.lit(m.root).cast("string")
    return folded.select(F.col("_id").alias(order), "leaf", "subroot", root.alias("root"), "path", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))


def _field_sql(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in COLUMNS) + ")"


#: Unsigned CRC-32 of a decimal number: bit by bit, lowest first, with the reflected polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))),
  lambda acc, b: xor(acc >> 1, CASE WHEN xor(acc, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"""

_SQL = rf"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS copy
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM rows),
tree(s, lvl, p, h) AS (
  SELECT s, 0, p, leaf FROM leaves
  UNION ALL
  SELECT s, lvl + 1, p // 3, sha256(string_agg(h, '' ORDER BY p))
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM tree) WHERE n > 1 GROUP BY s, lvl, p // 3),
nodes AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (SELECT s, max(lvl) AS height, arg_max(h, lvl) AS subroot FROM nodes GROUP BY s),
upper_tree(lvl, p, h) AS (
  SELECT 0, s, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, p // 3, sha256(string_agg(h, '' ORDER BY p))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_tree) WHERE n > 1 GROUP BY lvl, p // 3),
tops AS MATERIALIZED (SELECT * FROM upper_tree),
top AS (SELECT max(lvl) AS height, arg_max(h, lvl) AS root FROM tops),
steps AS MATERIALIZED (
  SELECT a.s, a.lvl, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM nodes a JOIN nodes b ON a.s = b.s AND a.lvl = b.lvl AND a.p // 3 = b.p // 3 GROUP BY ALL),
top_steps AS MATERIALIZED (
  SELECT a.lvl, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.p // 3 = b.p // 3 GROUP BY ALL),
fold(s, p, lvl, node, h, proof) AS (
  SELECT s, p, 0, p, copy, '' FROM leaves
  UNION ALL
  SELECT f.s, f.p, f.lvl + 1, CASE WHEN f.lvl < z.height THEN f.node // 3 WHEN f.lvl = z.height THEN f.s // 3 ELSE f.node // 3 END,
         sha256(coalesce(x.l, y.l) || f.h || coalesce(x.r, y.r)), f.proof || coalesce(x.l || x.r, y.l || y.r)
  FROM fold f JOIN subroots z ON f.s = z.s CROSS JOIN top
  LEFT JOIN steps x ON f.lvl < z.height AND x.s = f.s AND x.lvl = f.lvl AND x.p = f.node
  LEFT JOIN top_steps y ON f.lvl >= z.height AND y.lvl = f.lvl - z.height
       AND y.p = CASE WHEN f.lvl = z.height THEN f.s ELSE f.node END
  WHERE f.lvl < z.height + top.height)
SELECT d.doc_id, d.leaf, z.subroot, top.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM leaves d JOIN subroots z ON d.s = z.s CROSS JOIN top
JOIN fold f ON f.s = d.s AND f.p = d.p AND f.lvl = z.height + top.height
"""


@query("op11_merkle", _SQL)
def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(docs.doc_id.cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate(docs.text, "\n", "")).otherwise(docs.text)
    found = audit(docs, {"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
                        "folded_root", "verified")
