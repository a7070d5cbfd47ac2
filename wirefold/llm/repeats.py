"""Substring dedup: winnowed anchors as seeds, extension by classes of equal surroundings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import drop_stored, query, release, store, table, text_batches
from wirefold.llm.words import bitmap, in_bitmap, shingles, word_hashes

#: Words of the shortest repeat that goes, and of an anchor.
WINDOW, ANCHOR = 35, 16
#: Bits of the filters on anchors that occur again and on texts with repeats: 2 MB, 2^19 rows to the driver, at every size.
FILTER_BITS = 24
#: Words are what is between ASCII white space, unchanged.
BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: A text by 128 bits; equal texts have equal repeats.
KEY = ["k1", "k2"]


def _seeds(text: str | None, window: int, anchor: int):
    """Winnowing: each window of ``window`` words elects the smallest of its anchors (runs of ``anchor``
    words), the leftmost on ties, which depends on its words alone. Neighbouring windows that elect
    the same anchor form a run: ``(anchor hash, first window, number of windows)`` per run, and the
    hashes of all windows."""
    h = word_hashes(text, BLANKS)
    whole = shingles(h * _MIX, window)
    if not len(whole):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), whole
    grams = shingles(h, anchor)
    span = window - anchor + 1
    best, reach = np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        reach += step
    first = np.flatnonzero(np.diff(best, prepend=-1))
    return grams[best[first]], first, np.diff(first, append=len(best)), whole


def _anchors(window: int, anchor: int):
    """Anchors of the texts, with the number of times (2 for more)."""

    def run(batches):
        release()
        for batch in batches:
            found = [_seeds(t, window, anchor)[0] for t in batch.column(0).to_pylist()]
            a, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(np.minimum(n, 2))], ["a", "n"])

    return run


def _runs(again, window: int, anchor: int):
    """Runs whose anchor may occur again: text key, first window, anchor, hashes of its windows."""

    def run(batches):
        release()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows, starts, seeds, sizes, hashes = [], [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                a, first, n, whole = _seeds(text, window, anchor)
                kept = in_bitmap(again.value, a)
                if not kept.any():
                    continue
                hashes.append(whole[np.repeat(kept, n)])
                a, first, n = a[kept], first[kept], n[kept]
                rows.append(np.full(len(a), row))
                starts.append(first), seeds.append(a), sizes.append(n)
            if not rows:
                continue
            rows, ends = np.concatenate(rows), np.cumsum(np.concatenate(sizes))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                             pa.array(np.concatenate(hashes).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[rows]), pa.array(k2[rows]), pa.array(np.concatenate(starts), pa.int64()),
                 pa.array(np.concatenate(seeds).view(np.int64)), lists], [*KEY, "start", "a", "windows"])

    return run


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return text_batches(docs).select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(WINDOW), text).alias("k2"), text.alias("text"), *more)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = FILTER_BITS) -> DataFrame:
    """Repeated windows of ``docs(text)``: ``(k1, k2, starts)``, per text key (see ``KEY``) the runs
    ``(start, mask)``: bit i of ``mask`` says that the window at word ``start + i`` has its words in
    a row somewhere else too, in the same text or another row. Texts without any are left out.

    1. Seed: every window elects an anchor, so equal windows meet at equal anchors. Anchors that
       occur once in the corpus (a counted filter; false alarms cost work) seed nothing.
    2. Extend both ways, by classes instead of pairs: occurrences of an anchor with the same
       surroundings (all windows that elected it) are one class with a count. A class of two is
       repeated as far as it reaches. Classes of one anchor that differ agree on some of its
       windows, so many words to the left and so many to the right: those are counted over classes.
       A group of n equal copies costs n rows, not n squared.
    3. What is covered by repeated windows is the union of the maximal repeats.

    Windows are compared by 128 bits (anchor and window hash). Null, empty and short texts have no
    window; rows with equal texts are copies of each other; other columns play no part.
    """
    spark = docs.sparkSession
    span = window - anchor + 1
    texts = _keyed(docs)
    seen = (texts.select("text").mapInArrow(_anchors(window, anchor), "a long, n long").groupBy("a")
            .agg(F.sum("n").alias("n")).where("n > 1"))
    again = spark.sparkContext.broadcast(bitmap(seen, "a", bits))
    runs = store(texts.mapInArrow(_runs(again, window, anchor),
                                  "k1 long, k2 long, start long, a long, windows array<long>"))
    classes = store(runs.groupBy("a", "windows").agg(F.count("*").alias("n"))
                    .withColumn("c", F.xxhash64("windows")))
    # surroundings that differ around one anchor: which of their windows are there twice?
    shared = classes.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    apart = (classes.join(shared, "a").select("a", "c", "n", F.posexplode("windows").alias("i", "w")))
    twice = apart.groupBy("a", "w").agg(F.sum("n").alias("m")).where("m > 1").select("a", "w")
    partly = (apart.where("n = 1").join(twice, ["a", "w"]).groupBy("a", "c")
              .agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask")))
    whole = classes.where("n > 1").select("a", "c", F.expr("shiftleft(1L, size(windows)) - 1").alias("mask"))
    masks = whole.union(partly)
    spots = (runs.select(*KEY, "start", "a", F.xxhash64("windows").alias("c")).join(masks, ["a", "c"])
             .select(*KEY, "start", "mask").distinct())
    out = store(spots.groupBy(*KEY).agg(F.collect_list(F.struct("start", "mask")).alias("starts")))
    drop_stored(runs)
    drop_stored(classes)
    assert span < 63
    return out


def _covered(n: int, starts, window: int) -> np.ndarray:
    """Which of n words some repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for run in starts if starts is not None else ():
        first = np.array([run["start"] + i for i in range(run["mask"].bit_length()) if run["mask"] >> i & 1])
        np.add.at(edge, first, 1)
        np.add.at(edge, first + window, -1)
    return np.cumsum(edge)[:n] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` plus ``kept_text`` (the words outside all repeats, joined by one blank; every copy of a
    repeat goes, the first too), ``repeat_words`` and ``all_words``. Null texts have no words.

    Only texts that may have repeats (a fixed-size filter of their keys) are shuffled to meet them;
    a text's list of runs is bounded by its own length. Columns of these names are replaced."""
    spark = docs.sparkSession
    found = repeats(docs, window, anchor, bits)
    some = spark.sparkContext.broadcast(bitmap(found, "k1", bits))
    names = ("kept_text", "repeat_words", "all_words")

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(some.value, key.to_numpy(np.int64).view(np.uint64)))

    @F.pandas_udf("kept_text string, repeat_words long, all_words long")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        release()
        out = []
        for text, runs in zip(texts, starts):
            words = text.encode().translate(BLANKS).split()
            gone = _covered(len(words), runs, window)
            kept = [w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words
            out.append((b" ".join(kept).decode(), int(gone.sum()), len(words)))
        return pd.DataFrame(out, columns=list(names))

    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [c for c in docs.columns if c not in names]
    keyed = text_batches(docs).select(*columns, F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(WINDOW), text).alias("_k2"))
    keyed = keyed.withColumn("_may", may("_k1"))
    lists = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("starts").alias("_starts"))
    none = F.lit(None).cast(found.schema["starts"].dataType)
    joined = (keyed.where("_may").join(lists, ["_k1", "_k2"], "left").select(*columns, "_starts")
              .union(keyed.where("NOT _may").select(*columns, none.alias("_starts"))))
    return joined.withColumn("_cut", cut(text, "_starts")).select(*columns, "_cut.*")


_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
sums AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)
"""


@query("op13_repeats", _SQL)
def op13_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        "doc_id", F.col("all_words").alias("n_words"), F.col("repeat_words").alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
