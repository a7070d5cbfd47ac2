"""Quality rules, line first: failing lines go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import query, release, table, text_batches

#: Word-level limits of the whole document: fixed values of the task.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Rules per line.
SPACE = " \t\n\x0b\x0c\r"
CLOSERS = SPACE + "\"')]}»”’"
TERMINAL = ".!?…:;。！？"
SHORT_LINE = 8                     # words below which a line has to end in a terminal mark
LINE_SYMBOLS = "#*$%&|<>{}[]=_~^"  # one in ten characters is too many
SEPARATORS = ["|", ">", "»", "›", "•", "·", "/", "::"]
BOILERPLATE_WORDS = 40             # longer lines are prose that mentions a phrase
BOILERPLATE = ["cookie policy", "accept cookies", "use of cookies", "enable javascript", "lorem ipsum",
               "terms of use", "terms of service", "privacy policy", "all rights reserved", "click here",
               "read more", "sign in", "log in", "subscribe to", "follow us", "share this"]
#: A document goes if the lines that stay hold less than this share of its non-space characters.
MIN_KEPT_PERCENT = 50

_phrases = re.compile("|".join(BOILERPLATE), re.I | re.A)
_separators = frozenset(s.encode() for s in SEPARATORS)

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "base_failed boolean, n_lines long, n_failed_lines long, kept_chars long, kept boolean")


def _chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACE))


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that the text holds twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n, reach = 0, 0
    for i in compress(range(len(windows)), (times[w] > 1 for w in windows)):
        n += i + 3 - max(i, reach)
        reach = i + 3
    return n


def line_fails(line: str, words: list[bytes]) -> bool:
    """Navigation (separators between items), punctuation (a short line that ends in no terminal
    mark, or one symbol in ten characters) and boilerplate phrases. ``words``: not empty."""
    seps = sum(w in _separators for w in words)
    if seps >= 2 and 5 * seps >= len(words):
        return True
    if len(words) < SHORT_LINE and line.rstrip(CLOSERS)[-1:] not in TERMINAL:
        return True
    if 10 * sum(map(line.count, LINE_SYMBOLS)) >= _chars(line):
        return True
    return len(words) <= BOILERPLATE_WORDS and _phrases.search(line) is not None


def measure(text: str | None) -> tuple:
    """All statistics of one text, and the text without its failing lines."""
    text = text or ""
    words = text.encode().split()
    chars = _chars(text)
    repeat = repeated_words(words)
    seen, dup, n_lines, failed, lost, stay = set(), 0, 0, 0, 0, []
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            n_lines += 1
            dup += line in seen
            seen.add(line)
            if line_fails(line, own):
                failed += 1
                lost += _chars(line)
                continue
        stay.append(line)
    base = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not base and 100 * (chars - lost) >= MIN_KEPT_PERCENT * chars
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat, base, n_lines, failed,
            chars - lost, kept, "\n".join(stay))


def _measured(with_text: bool):
    schema = f"{STATS}, clean_text string" if with_text else STATS
    names = [c.split()[0] for c in schema.split(",")]

    @F.pandas_udf(schema)
    def measured(texts: pd.Series) -> pd.DataFrame:
        release()
        return pd.DataFrame([measure(t)[:len(names)] for t in texts], columns=names)

    return measured


def line_quality(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Add the statistics in ``STATS``, and ``clean_text`` if asked, to rows with a ``text`` column.

    Lines are split at ``\\n``; one with a word fails by the rules of ``line_fails``; blank lines
    stay. ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word
    windows. ``kept``: not base_failed, and the lines that stay hold at least half of the
    non-space characters. A null text counts as empty (not kept). Repeated rows and other columns
    stay; columns named like an output are replaced.
    """
    names = [c.split()[0] for c in STATS.split(",")] + ["clean_text"] * with_text
    out = text_batches(docs).drop(*names).withColumn("_quality", _measured(with_text)("text"))
    return out.select("*", "_quality.*").drop("_quality")


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their failing lines removed; the columns of ``docs`` (``n_chars``,
    if there, follows the text)."""
    out = line_quality(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), with_text=True).where("kept")
    cols = []
    for f in docs.schema.fields:
        value = F.col("_doc")[f.name]
        if f.name == "text":
            value = F.col("clean_text")
        elif f.name == "n_chars":
            value = F.length("clean_text").cast(f.dataType)
        cols.append(value.alias(f.name))
    return out.select(*cols)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (SELECT r, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
                  length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
           FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT *, len(list_filter(w, lambda x: x IN ({', '.join(map(_quoted, SEPARATORS))}))) AS seps,
         right(rtrim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || {_quoted(CLOSERS.replace(SPACE, ' '))}), 1) AS last,
         length(line) - length(translate(line, {_quoted(LINE_SYMBOLS)}, '')) AS symbols,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM worded),
failing AS (
  SELECT *, (seps >= 2 AND 5 * seps >= len(w))
         OR (len(w) < {SHORT_LINE} AND last <> '' AND NOT contains({_quoted(TERMINAL)}, last))
         OR 10 * symbols >= chars
         OR (len(w) <= {BOILERPLATE_WORDS} AND regexp_matches(low, '{'|'.join(BOILERPLATE)}')) AS fails
  FROM judged),
per_line AS (SELECT r, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost, count(*) - count(DISTINCT line) AS dup
             FROM failing GROUP BY r),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
repeated AS (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated WHERE n >= 2) GROUP BY r),
stats AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost, 0) AS lost
  FROM docs LEFT JOIN per_line USING (r) LEFT JOIN covered USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (word_chars - lost) >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM based
"""


@query("op4_line_rules", _SQL)
def op4_line_rules(spark, sf_dir):
    return (line_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept"))
