"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wirefold.llm.common import WORD, query, store, table

#: Least number of blocks that the whole mix is cut into, output shards, and times a source may be
#: repeated; blocks that the smallest positive target has at least.
N_BLOCKS, N_SHARDS, REPEATS, LEAST_BLOCKS = 65_536, 64, 3, 16
SEED = "mix-1"
#: Rows that one window task over a part of a source holds on average.
ROWS_PER_PART = 1_024


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, size)`` rows -> one row per source: ``s_null, s_name, rnk, n, weight, target``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes; a target stops at ``REPEATS`` times its source's size and what is left over is shared
    again by weight until no target is above (water level over the sources sorted by size for
    weight). Windows here run over one row per source.
    """
    src = (sizes.groupBy("source").agg(F.sum("size").alias("n"))
           .select(F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_name"), "n"))
    src = src.withColumn("rnk", F.row_number().over(W.orderBy("s_null", "s_name")))
    src = src.withColumn("weight", ((F.col("rnk") - 1) % 3 + 1).cast("long"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # sources in the order in which a rising common level reaches their caps
    rising = W.orderBy((F.col("n") * F.expr("6 div weight")), "rnk")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    src = (src.withColumn("total", F.sum("n").over(everything))
           .withColumn("all_weight", F.sum("weight").over(everything))
           .withColumn("left_tokens", F.col("total") - F.coalesce(F.sum(F.col("n") * REPEATS).over(before), F.lit(0)))
           .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("capped", F.col("n") * REPEATS * F.col("left_weight") <= F.col("weight") * F.col("left_tokens")))
    free_tokens = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("n") * REPEATS)).over(everything), F.lit(0))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return (src.withColumn("free_tokens", free_tokens).withColumn("free_weight", free_weight)
            .withColumn("target", F.when(F.col("capped"), (F.col("n") * REPEATS).cast("double"))
                        .otherwise(F.col("weight").cast("double") * F.col("free_tokens") / F.col("free_weight")))
            .select("s_null", "s_name", "rnk", "n", "weight", "total", "target"))


def seats(targets: DataFrame, n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS) -> DataFrame:
    """The blocks of the mix dealt to sources by highest quotients ``target / (2k + 1)``.

    One row per block: ``rnk`` (source), ``k`` (the source's seat number), ``seat`` (order of
    award, ties to the earlier source) and ``shard`` (equal runs of the order, so every shard
    has integer quotas close to the weights). No source can win more than
    ``target * (n_blocks + sources) / total + 1`` seats, so no more are listed.
    """
    n_sources = F.count("*").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    most = F.floor(F.col("target") * (n_blocks + F.col("n_sources")) / F.col("total")) + 1
    listed = (targets.where("total > 0 and target > 0").withColumn("n_sources", n_sources)
              .select("rnk", "target", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("k"))
              .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1)))
    order = W.orderBy(F.desc("quotient"), "rnk")
    return (listed.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= n_blocks)
            .withColumn("shard", F.floor((F.col("seat") - 1) * n_shards / n_blocks))
            .select("rnk", "k", "seat", "shard"))


def enough_blocks(targets: DataFrame, n_blocks: int = N_BLOCKS) -> int:
    """``n_blocks``, doubled until the smallest positive target is ``LEAST_BLOCKS`` blocks or more."""
    least = targets.where("target > 0").agg(F.min("target"), F.max("total")).first()
    while least[0] and least[0] * n_blocks < LEAST_BLOCKS * least[1]:
        n_blocks *= 2
    return n_blocks


def block_counts(targets: DataFrame, n_blocks: int) -> DataFrame:
    """``rnk, blocks``: how many of ``seats`` each source has, with a few rows per source however
    many blocks there are.

    A source has ``round(target * level)`` seats of quotient ``1 / (2 * level)`` or more. At the level
    ``(n_blocks - sources / 2) / total`` these are no more than ``n_blocks`` together and no more than
    ``sources`` less; so they (but one of each, against rounding) are awarded as they are, and only
    the rest goes by quotients.
    """
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sure = F.floor(F.col("target") * (n_blocks - F.col("n_sources") / 2) / F.col("total") + 0.5) - 1
    most = F.floor(F.col("target") * (n_blocks + F.col("n_sources")) / F.col("total")) + 1
    sources = (targets.where("total > 0 and target > 0").withColumn("n_sources", F.count("*").over(everything))
               .withColumn("sure", F.greatest(F.lit(0).cast("long"), sure))
               .withColumn("open", F.lit(n_blocks) - F.sum("sure").over(everything)))
    listed = (sources.select("rnk", "target", "open", F.explode(F.sequence("sure", most)).alias("k"))
              .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1)))
    won = (listed.withColumn("seat", F.row_number().over(W.orderBy(F.desc("quotient"), "rnk")))
           .where("seat <= open").groupBy("rnk").agg(F.count("*").alias("won")))
    return (sources.join(won, "rnk", "left")
            .select("rnk", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("blocks")))


def shard_quotas(targets: DataFrame, n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS) -> DataFrame:
    """Integer quotas: ``shard, rnk, blocks``."""
    return seats(targets, n_blocks, n_shards).groupBy("shard", "rnk").agg(F.count("*").alias("blocks"))


def mix(docs: DataFrame, seed: str = SEED, n_blocks: int = N_BLOCKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, source, size)`` -> the same rows with ``source_size, target, taken``, and
    the columns in ``keep``.

    A source's documents, put in the order of ``md5(seed:doc_id)``, form a stream of words that is
    cut into blocks of ``total / n_blocks`` words (``n_blocks`` grows until the smallest positive
    target is ``LEAST_BLOCKS`` blocks, so no source is lost beside large ones); the source takes as many blocks as it has seats,
    from the start of that seeded order and around again for repeats. ``taken`` counts the words
    of a document inside the taken blocks, repeats counted; never above ``REPEATS`` times its size.
    The running position is a window within (source, leading digits of the hash) plus the sums of
    the parts before it, so a hot source is spread over many tasks. Null size counts as 0, null
    ids are placed like the empty text; ties and repeated rows keep one place each; an empty table
    gives no rows.
    """
    docs = store(docs.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
                             F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                   .cast("binary")).alias("place"),
                             F.col("source").isNull().alias("s_null"),
                             F.coalesce("source", F.lit("")).alias("s_name"), *keep))
    rows, digits = docs.count(), 1
    while 16 ** digits * ROWS_PER_PART < rows:
        digits += 1
    docs = docs.withColumn("part", F.substring("place", 1, digits))
    targets = store(source_targets(docs))
    n_blocks = enough_blocks(targets, n_blocks)
    quota = block_counts(targets, n_blocks)
    plan = (targets.join(quota, "rnk", "left").fillna(0, ["blocks"])
            .withColumn("wanted", F.least(F.col("n") * REPEATS, F.expr(f"cast(blocks as decimal(19)) * cast(total as decimal(19)) div {n_blocks}")))
            .select("s_null", "s_name", F.col("n").alias("source_size"), "target", "wanted"))
    key = ["s_null", "s_name"]
    parts = docs.groupBy(*key, "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    within = (W.partitionBy(*key, "part").orderBy("place", "doc_id", "size", *keep)
              .rowsBetween(W.unboundedPreceding, -1))
    placed = (docs.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(parts, [*key, "part"]).join(plan, key)
              .withColumn("start", F.col("part_start") + F.col("offset")))
    n, w = F.col("source_size"), F.col("wanted")
    whole = F.when(n > 0, F.expr("wanted div source_size")).otherwise(0)
    rest = w - whole * n
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("size") * whole + part).cast("long").alias("taken"), *keep)


def mix_documents(docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` over whole documents: ``size`` is the number of words of ``text`` (null: 0)."""
    return mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *keep), seed, keep=keep)


def take_words(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document row as often as the mix takes it whole, and once more with its
    first words where a block border falls inside it; rows of which nothing is taken go. Columns
    of ``docs`` stay (``n_chars``, if there, follows the text)."""
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    taken = (mix_documents(hashed, seed, ("_hash",)).groupBy("doc_id", "source", "_hash")
             .agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count("*").alias("_rows"))
             .where("_taken > 0").toDF("_doc", "_source", "_text_hash", "_taken", "_size", "_rows"))
    rows = hashed.join(store(taken), F.col("doc_id").eqNullSafe(F.col("_doc"))
                       & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_text_hash")))
    # equal rows share one sum
    rows = rows.where("_rows = 1").unionByName(
        rows.where("_rows > 1").dropDuplicates(["_doc", "_source", "_text_hash"]))
    rows = (rows.withColumn("_time", F.explode(F.expr("sequence(1L, (_taken + _size - 1) div _size)")))
            .withColumn("_words", F.expr("least(_size, _taken - (_time - 1) * _size)")))
    # each piece is a word with the white space before it
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), ""))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         source IS NULL AS s_null, coalesce(source, '') AS s_name
  FROM documents),
src0 AS (SELECT s_null, s_name, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY ALL),
src1 AS (SELECT *, row_number() OVER (ORDER BY s_null, s_name) AS rnk FROM src0),
src2 AS (SELECT *, (rnk - 1) % 3 + 1 AS weight FROM src1),
src3 AS (
  SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(n * 3) OVER (ORDER BY n * (6 // weight), rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(weight) OVER (ORDER BY n * (6 // weight), rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM src2),
src4 AS (SELECT *, n * 3 * (all_weight - weights) <= weight * (total - caps) AS capped FROM src3),
src5 AS (
  SELECT *, CASE WHEN capped THEN CAST(n * 3 AS DOUBLE) ELSE CAST(weight AS DOUBLE)
    * CAST(total - coalesce(sum(CASE WHEN capped THEN n * 3 END) OVER (), 0) AS DOUBLE)
    / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) END AS target
  FROM src4),
listed AS (
  SELECT rnk, target / (2 * k + 1) AS quotient
  FROM (SELECT rnk, target, unnest(range(CAST(floor(target * (65536 + count(*) OVER ()) / total) AS BIGINT) + 2)) AS k
        FROM src5 WHERE total > 0 AND target > 0)),
quota AS (
  SELECT rnk, count(*) AS blocks
  FROM (SELECT rnk, row_number() OVER (ORDER BY quotient DESC, rnk) AS seat FROM listed) WHERE seat <= 65536 GROUP BY rnk),
plan AS (
  SELECT s_null, s_name, n, target, least(n * 3, coalesce(blocks, 0) * total // 65536) AS wanted
  FROM src5 LEFT JOIN quota USING (rnk)),
placed AS (
  SELECT d.*, n, target, wanted,
         coalesce(sum(size) OVER (PARTITION BY d.s_null, d.s_name ORDER BY place, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN plan USING (s_null, s_name))
SELECT doc_id, size, n AS source_size, target,
       CAST(CASE WHEN n > 0 THEN size * (wanted // n) + greatest(0, least(size, wanted % n - start)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""


@query("op5_mixing", _SQL)
def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")
