"""Facts pulled out of raw text columns with native regex functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HREF_PATTERN = r'href="([^"]*)"'


def link_facts(docs: DataFrame, *, doc_id: str, text: str, pattern: str = HREF_PATTERN,
               group: int = 1, out: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Ordered facts of a document: every match of ``pattern`` in the whole text with its
    0-based position. Pure column functions, so it runs inside whole-stage codegen."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), group)
    return docs.select(*keys, doc_id, F.posexplode(found).alias("pos", out))


def parse_quarantine(rows: DataFrame, *, row_id: str, payload: str, schema: str,
                     keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One pass, two outputs: parsed rows and rejects with a reason.

    ``from_json`` in PERMISSIVE mode keeps a malformed payload in a corrupt-record column
    instead of failing the task; such rows (and null payloads) become rejects, so no row is
    dropped silently. The reason carries the payload's whole first line.
    """
    corrupt = "_corrupt_record"
    parsed = rows.select(*keys, row_id, F.col(payload).alias("_payload"),
                         F.from_json(F.col(payload), f"{schema}, {corrupt} string",
                                     {"mode": "PERMISSIVE",
                                      "columnNameOfCorruptRecord": corrupt}).alias("_parsed"))
    bad = F.col("_parsed").isNull() | F.col(f"_parsed.{corrupt}").isNotNull()
    reason = F.when(F.col("_payload").isNull(), F.lit("empty-payload")).otherwise(
        F.concat(F.lit("malformed: "), F.substring_index(F.col("_payload"), "\n", 1)))
    good = parsed.filter(~bad).select(*keys, row_id, "_parsed.*").drop(corrupt)
    rejects = parsed.filter(bad).select(*keys, row_id, reason.alias("reason"))
    return good, rejects
