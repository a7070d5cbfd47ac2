"""Benchmark decontamination: prefix-filtered set join of item windows with documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import query, release, store, table, text_batches
from wirefold.llm.words import bitmap, in_bitmap, shingles, word_hashes

#: Words of a window (an item of fewer is one window) and of the shingles that it is a set of.
WINDOW, SHINGLE = 10, 5
#: Bits of the filter that says which shingles some item has: 4 MB at every size of input.
FILTER_BITS = 25

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased: every other ASCII character
#: becomes a blank.
FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
             for c in range(256))


def _windows(batches):
    """Every shingle of every window of every item: the window's word hashes, size, shingle size,
    the shingle's offset in the window, its hash."""
    for pdf in batches:
        rows = []
        for item, text in zip(pdf.item_id, pdf.text):
            h = word_hashes(text, FOLD)
            if not len(h):
                continue
            size = min(WINDOW, len(h))
            k = min(SHINGLE, size)
            s = shingles(h, k).view(np.int64)
            for start in range(len(h) - size + 1):
                window = h[start:start + size].tobytes()
                rows += [(item, window, size, k, o, int(s[start + o])) for o in range(size - k + 1)]
        yield pd.DataFrame(rows, columns=["item_id", "window", "size", "k", "o", "shingle"])


def _candidates(known, sizes):
    """Per text: number of words, and the positions whose shingle may be an item's, each with the
    hashes of the words around it (what any window over the shingle can hold)."""
    margin = WINDOW - 1

    @F.pandas_udf("n_words long, found array<struct<k:int,pos:long,shingle:long,around:binary>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        release()
        out = []
        for text in texts:
            h = word_hashes(text, FOLD)
            hits = []
            for k in sizes:
                s = shingles(h, k)
                for p in np.flatnonzero(in_bitmap(known.value, s)):
                    p = int(p)
                    before = max(0, p - margin)
                    around = bytes(8 * (margin - (p - before))) + h[before:p + margin + 1].tobytes()
                    hits.append({"k": k, "pos": p, "shingle": int(s[p].view(np.int64)), "around": around})
            out.append((len(h), hits))
        return pd.DataFrame(out, columns=["n_words", "found"])

    return found


def find_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` x ``items(item_id, text)`` -> one row per document row: ``doc_id,
    text_hash, n_words, n_hit, items`` (sorted list of the item ids as strings).

    A window (``WINDOW`` consecutive words of an item, or the whole of a shorter one) occurs where
    the document has the same words in a row; a document word inside an occurrence is hit.

    1. One pass over the documents keeps the positions whose shingle some item may have (a fixed
       4 MB filter; false alarms cost work, nothing is lost) and counts words.
    2. Those positions give the number of times that documents hold each shingle. Containment must
       be full, so one prefix token per window is enough: its rarest shingle. Windows with a
       shingle that no document holds go.
    3. Positions meet prefix tokens in an equi-join; the window must lie inside the document, and
       the words there must equal the window's.

    Null text has no words; items without words never occur; empty tables and repeated rows are
    fine; other columns play no part.
    """
    spark = docs.sparkSession
    parts = store(items.select("item_id", "text").mapInPandas(
        _windows, f"item_id {items.schema['item_id'].dataType.simpleString()}, window binary, size int, k int, o int, shingle long"))
    sizes = [r.k for r in parts.select("k").distinct().orderBy("k").collect()]  # at most SHINGLE values
    known = spark.sparkContext.broadcast(bitmap(parts, "shingle", FILTER_BITS))
    seen = store(text_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"),
                             _candidates(known, sizes)("text").alias("c"))
                 .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "c.*"))
    found = seen.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    times = found.groupBy("k", "shingle").agg(F.count("*").alias("times"))
    shingle_rows = parts.select("window", "size", "k", "o", "shingle").distinct()
    rated = shingle_rows.join(times, ["k", "shingle"], "left")
    prefix = (rated.groupBy("window", "size", "k")
              .agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "o")).alias("p"))
              .where("p.times > 0").select("window", "size", "k", "p.shingle", "p.o"))
    start = F.col("pos") - F.col("o")
    hits = (found.join(prefix, ["k", "shingle"])
            .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
            .where(F.expr(f"substring(around, ({WINDOW - 1} - o) * 8 + 1, size * 8) = window"))
            .select("row", start.alias("start"), "size", "window"))
    hits = store(hits)
    words = (hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p"))
             .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    names = (hits.select("row", "window").distinct()
             .join(parts.select("window", F.col("item_id").cast("string").alias("item")).distinct(), "window")
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return (seen.select("row", "doc_id", "text_hash", "n_words").join(words, "row", "left").join(names, "row", "left")
            .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, unchanged."""
    bad = (find_contamination(docs, items).where("n_hit > 0").select("doc_id", "text_hash").distinct()
           .toDF("_bad_doc", "_bad_text"))
    on = F.col("doc_id").eqNullSafe(F.col("_bad_doc")) & (F.xxhash64("text") == F.col("_bad_text"))
    return docs.join(bad, on, "left_anti")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)),
hits AS (SELECT r, i, m, item FROM grams JOIN windows USING (m, win)),
words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
names AS (SELECT r, list_sort(list(DISTINCT item)) AS found FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""


@query("op10_decontaminate", _SQL)
def op10_decontaminate(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
