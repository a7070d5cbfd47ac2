"""Phrase collocations: the longest windows are counted once, shorter phrases are their marginals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm.common import drop_stored, query, release, store, table, text_batches
from wirefold.llm.words import word_hashes

#: Words of the longest phrase, occurrences of a candidate, share that absorbs a phrase, rows per language.
LONGEST, MIN_COUNT, INSIDE, TOP = 5, 100, 100, 2000
#: Slots of the filter on word pairs (one byte each while it is built, one bit as broadcast), and of its parts.
PAIR_BITS, PART_BITS, MERGED = 24, 16, 256
#: Windows that a task combines at a time.
COMBINED = 1 << 20
#: Piece ends; with blanks they are all that is no word.
ENDS = b".,;:!?\n\x0b\x0c\r"
MARKS = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = bytes(32 if c == 10 else c for c in MARKS)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _tokens(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Words of all texts in order: hashes (never 0), numbers of their pieces, the folded bytes and
    where in them each word starts and ends. A text's end is a piece's end."""
    joined = "\n".join(t for t in texts if t)
    raw = joined.encode().translate(MARKS)
    hashes = word_hashes(joined, BLANKS)
    hashes[hashes == 0] = 1
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = (b != 32) & (b != 10)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    pieces = np.cumsum(b == 10, dtype=np.int64)[starts] if len(b) else np.zeros(0, np.int64)
    return hashes, pieces, raw, starts, ends


def _pair_slots(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Slot of each word and its next one."""
    h = (hashes[:-1] ^ np.uint64(salt)) * _A + hashes[1:] * _B
    h ^= h >> np.uint64(32)
    h *= _B
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list]]:
    langs, salts, texts = (batch.column(i) for i in range(3))
    frame = pd.DataFrame({"lang": langs.to_pylist(), "salt": salts.to_pylist()})
    for lang, rows in frame.groupby("lang").indices.items():
        yield lang, int(frame.salt[rows[0]]) & (2 ** 64 - 1), texts.take(pa.array(rows)).to_pylist()


def _sketch(bits: int):
    """Per task: how often each slot of word pairs is met, at most 255, in parts."""

    def run(batches):
        release()
        seen = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for _, salt, texts in _by_lang(batch):
                hashes, pieces, *_ = _tokens(texts)
                for at in range(0, len(hashes), COMBINED):
                    h, p = hashes[at:at + COMBINED + 1], pieces[at:at + COMBINED + 1]
                    slots = np.sort(_pair_slots(h, salt, bits)[p[:-1] == p[1:]])
                    first = np.flatnonzero(np.diff(slots, prepend=-1))
                    n = np.diff(first, append=len(slots))
                    slots = slots[first]
                    seen[slots] = np.minimum(n + seen[slots], 255)
        parts = seen.reshape(-1, 1 << min(bits, PART_BITS))
        used = np.flatnonzero(parts.any(axis=1))
        for i in used:
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([parts[i].tobytes()])], ["part", "seen"])

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows.seen.iloc[0]), np.uint8)
    for x in rows.seen:
        total = np.minimum(total.astype(np.uint16) + np.frombuffer(x, np.uint8), 255).astype(np.uint8)
    return pd.DataFrame({"part": [rows.part.iloc[0]], "piece": [rows.piece.iloc[0] // MERGED], "seen": [total.tobytes()]})


def pair_filter(texts: DataFrame, min_count: int, bits: int = PAIR_BITS) -> np.ndarray:
    """One bit per slot: may a word pair of this slot occur ``min_count`` times? ``texts(lang, salt,
    text)``. Slots count at least what each of their pairs counts, so a frequent pair never misses;
    false alarms cost work. The driver gets 2^bits bits, however many texts there are."""
    schema = "part int, seen binary"
    rows = store(texts.mapInArrow(_sketch(bits), schema).withColumn("piece", F.spark_partition_id().cast("long")))
    while (pieces := rows.agg(F.max("piece")).first()[0] or 0) > 0:  # MERGED tasks at a time
        merged = store(rows.groupBy("part", F.expr(f"piece div {MERGED}").alias("_g")).applyInPandas(
            _merge, "part int, piece long, seen binary"))
        drop_stored(rows)
        rows = merged.select("part", "seen", "piece")
        if pieces < MERGED:
            break
    least = min(min_count, 255)

    @F.pandas_udf("binary")
    def enough(seen: pd.Series) -> pd.Series:
        return seen.map(lambda x: np.packbits(np.frombuffer(x, np.uint8) >= least).tobytes())

    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, (1 << min(bits, PART_BITS)) // 8)
    for part, packed in rows.select("part", enough("seen")).collect():
        out[part] |= np.frombuffer(packed, np.uint8)
    drop_stored(rows)
    return out.reshape(-1)


def _combine(lang: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Equal windows as one row with their number."""
    order = columns[0] * _A
    for c in columns[1:]:
        order = (order ^ (order >> np.uint64(29))) * _B + c
    by = np.argsort(order)
    columns = [c[by] for c in columns]
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(by))
    return _rows(lang, [c[first].view(np.int64) for c in columns], n, pa.nulls(len(first), pa.string()))


def _rows(lang: str, columns: list, n, words) -> pa.RecordBatch:
    names = ["lang", *[f"w{i + 1}" for i in range(len(columns))], "n", "word"]
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(words), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, *map(pa.array, columns), pa.array(n), words], names)


def _windows(pairs, longest: int, bits: int):
    """Per task: padded windows of ``longest`` words with their number, and, with 0 for n, each word
    of a window of at least two words together with its hash."""

    def run(batches):
        release()
        passing, known = np.unpackbits(pairs.value).astype(bool), set()
        waiting: dict[str, list] = {}
        for batch in batches:
            for lang, salt, texts in _by_lang(batch):
                hashes, pieces, raw, starts, ends = _tokens(texts)
                for at in range(0, len(hashes), COMBINED):
                    reach = slice(at, at + COMBINED + longest - 1)
                    h, p = hashes[reach], pieces[reach]
                    n = min(COMBINED, len(hashes) - at)
                    on = np.zeros(len(h) + longest, bool)  # does the phrase go on behind this word?
                    on[:len(h) - 1] = (p[:-1] == p[1:]) & passing[_pair_slots(h, salt, bits)] if len(h) > 1 else False
                    h = np.concatenate([h, np.zeros(longest, np.uint64)])
                    columns, alive = [h[:n]], np.ones(n, bool)
                    for k in range(1, longest):
                        alive = alive & on[k - 1:k - 1 + n]
                        columns.append(np.where(alive, h[k:k + n], np.uint64(0)))
                    waiting.setdefault(lang, []).append(columns)
                    used = on[:n].copy()
                    used[1:] |= on[:n - 1]
                    words, where = np.unique(h[:n][used], return_index=True)
                    places = np.flatnonzero(used)[where] + at
                    fresh = [(w, raw[starts[i]:ends[i]].decode()) for w, i in zip(words.view(np.int64).tolist(), places.tolist())
                             if w not in known]
                    if fresh:
                        known.update(w for w, _ in fresh)
                        ids = np.array([w for w, _ in fresh], np.int64)
                        zero = np.zeros(len(ids), np.int64)
                        yield _rows(lang, [ids, *[zero] * (longest - 1)], zero, pa.array([w for _, w in fresh]))
                    if sum(len(c[0]) for c in waiting[lang]) >= COMBINED:
                        yield _combine(lang, [np.concatenate(c) for c in zip(*waiting.pop(lang))])
        for lang, held in waiting.items():
            yield _combine(lang, [np.concatenate(c) for c in zip(*held)])

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT,
                  bits: int = PAIR_BITS) -> tuple[DataFrame, DataFrame]:
    """``docs(text, lang)`` -> counts ``(lang, ws, f)`` and ``words(w, word)``.

    ``ws`` are the hashes of a phrase's words; the empty phrase has the number of all words of its
    language. Whole are: the empty phrase, and phrases of at most ``longest`` words that occur
    ``min_count`` times or more. ``words`` gives the words of those phrases that have two or more.

    1. Every word starts one window: itself and its ``longest - 1`` lead columns, padded from where
       its piece ends or where two words meet that are no frequent pair (``pair_filter``; a phrase
       over such a pair cannot be frequent). Only these longest windows are counted.
    2. One ROLLUP over (lang, w1 .. w5) sums them by ever shorter prefixes: an occurrence of a phrase
       is the prefix of exactly one window.

    Null and empty texts have no words; a null lang is ``und``; repeated rows count as often as they
    are there; a text of any length is cut into windows in stretches; other columns play no part.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    texts = text_batches(docs).select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), "text")
    pairs = spark.sparkContext.broadcast(pair_filter(texts, min_count, bits))
    names = [f"w{i + 1}" for i in range(longest)]
    schema = "lang string, " + ", ".join(f"{w} long" for w in names) + ", n long, word string"
    rows = store(texts.mapInArrow(_windows(pairs, longest, bits), schema))
    windows = rows.where("word IS NULL").groupBy("lang", *names).agg(F.sum("n").alias("n"))
    # A prefix that ends in padding is no phrase; Catalyst takes this filter below the aggregate.
    phrase = F.coalesce(*[F.col(w) for w in reversed(names)], F.lit(1)) != 0
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f")).where(F.col("lang").isNotNull() & phrase)
    ws = sums.select("lang", F.array_compact(F.array(*names)).alias("ws"), "f")
    counts = store(ws.where(f"size(ws) = 0 OR f >= {int(min_count)}"))
    words = store(rows.where("word IS NOT NULL").groupBy(F.col("w1").alias("w")).agg(F.min("word").alias("word")))
    drop_stored(rows)
    return counts, words


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) of columns below 10^17, exact: products are decimals of 38 digits."""
    above = F.lit(1000).cast(T.DecimalType(4, 0)) * F.col(a).cast(T.DecimalType(17, 0)) * F.col(n).cast(T.DecimalType(17, 0))
    below = F.col(l).cast(T.DecimalType(17, 0)) * F.col(r).cast(T.DecimalType(17, 0))
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, inside: int = INSIDE,
                 top: int = TOP, bits: int = PAIR_BITS) -> DataFrame:
    """Phrases of 2 to ``longest`` words whose words keep together: per ``lang`` (null: ``und``) the first
    ``top`` as ``rank, phrase, a, l, r, n, score``.

    A phrase with ``a >= min_count`` occurrences scores floor(1000 a n / (l r)) at its weakest cut
    into a first part (l) and a rest (r), n words in all; ties go to the earliest cut. It goes where
    a longer candidate around it has ``inside`` percent of its occurrences or more. Order: score,
    a (both descending), phrase (bytes). Products are decimals of 38 digits.

    An empty table, and a language without frequent phrases, give no rows. Words are told apart
    by 64-bit hashes until the last step writes them out.
    """
    counts, words = phrase_counts(docs, longest, min_count, bits)
    totals = counts.where("size(ws) = 0").select("lang", F.col("f").alias("n"))
    found = counts.where("size(ws) >= 2").select("lang", "ws", F.col("f").alias("a"))
    subs = (found.where("size(ws) > 2").select("lang", "a", "ws", F.expr("explode(sequence(2, size(ws) - 1))").alias("m"))
            .select("lang", "a", F.expr("explode(transform(sequence(1, size(ws) - m + 1), i -> slice(ws, i, m)))").alias("ws"))
            .groupBy("lang", "ws").agg(F.max("a").alias("outer")))
    kept = found.join(subs, ["lang", "ws"], "left").where(f"outer IS NULL OR 100 * outer < {int(inside)} * a").drop("outer")
    cuts = kept.select("lang", "ws", "a", F.expr("explode(sequence(1, size(ws) - 1))").alias("k"))
    first = counts.select("lang", F.col("ws").alias("head"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("ws").alias("tail"), F.col("f").alias("r"))
    cuts = (cuts.withColumn("head", F.expr("slice(ws, 1, k)")).withColumn("tail", F.expr("slice(ws, k + 1, size(ws) - k)"))
            .join(first, ["lang", "head"]).join(rest, ["lang", "tail"]).join(totals, "lang"))
    scored = (cuts.withColumn("score", score("a", "n", "l", "r"))
              .groupBy("lang", "ws", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    spelled = (scored.select("lang", "ws", F.posexplode("ws").alias("i", "w")).join(words, "w").groupBy("lang", "ws")
               .agg(F.expr("array_join(transform(sort_array(collect_list(struct(i, word))), x -> x.word), ' ')").alias("phrase")))
    out = scored.join(spelled, ["lang", "ws"]).selectExpr("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
            .selectExpr("lang", "cast(rank as bigint) AS rank", "phrase", "a", "l", "r", "n", "score"))


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 100),
subs AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, j, unnest(range(1, m - j + 2)) AS i
        FROM (SELECT lang, w, a, m, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN subs USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS j FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n.n, j,
         (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
WHERE rank <= 2000
"""


@query("op12_collocations", _SQL)
def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
