"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import query, table

_WS = r"[\x20\x09-\x0D]"
#: Parts without readable text; an unclosed one runs to the end.
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(
    rf"<{t}(?:{_WS}|/|>).*?(?:</{t}{_WS}*>|\z)" for t in ["script", "style", "noscript", "template"])
#: Tags that end a line of text.
BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|"
          r"h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)"
          rf"(?:{_WS}|/)?[^>]*(?:>|\z)").replace(rf"(?:{_WS}|/)?[^>]*", rf"(?:(?:{_WS}|/)[^>]*)?")
TAGS = r"<[a-zA-Z/!?][^>]*(?:>|\z)"
#: Named references, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"),
            ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
            ("&amp;", "&")]
TITLE = rf"(?is)<title(?:{_WS}[^>]*)?>(.*?)</title"
LANG = rf"(?is)<html{_WS}[^>]*?lang{_WS}*=[\x20\x09-\x0D\x22']*([a-zA-Z0-9-]+)"
LINK = rf"(?is)<a{_WS}[^>]*?href{_WS}*=[\x20\x09-\x0D]*[\x22']([^\x22'>]*)"
CHARSET = r"(?i)charset=[\x22']?([a-zA-Z0-9_.:-]+)"
HEADER = r"\n([^\s:]+[\x20\x09]*:[^\r\n]*)"
CRLF = "\r\n"


def _unescape(text):
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _unescape_parts(text):
    """``_unescape`` in one pass for long texts: what follows each ampersand is looked at once. No
    replaced reference is part of another, so the order of ``ENTITIES`` makes no difference."""
    def resolved(part, i):
        out = F.concat(F.lit("&"), part)
        for name, char in reversed(ENTITIES):
            out = F.when(part.startswith(name[1:]), F.concat(F.lit(char), F.substring(part, len(name), 1 << 30))).otherwise(out)
        return F.when(i == 0, part).otherwise(out)

    return F.array_join(F.transform(F.split(text, "&"), resolved), "")


def _tidy(text):
    """Runs of blanks become one, lines lose outer blanks, empty lines go. The patterns match only
    what changes: a lone space or line end stays as it is."""
    text = F.regexp_replace(text, r"[\x09\x0B-\x0D\xA0][\x20\x09\x0B-\x0D\xA0]*|\x20[\x20\x09\x0B-\x0D\xA0]+", " ")
    return F.trim(F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def plain_text(html):
    """Readable text of an html column: hidden parts out, block tags to line ends, other tags out,
    references resolved, blanks tidied. A tag is taken to end at the first ``>``."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    return _tidy(_unescape_parts(text))


def record_id(*parts):
    """A stable ``<urn:uuid:...>`` from the parts."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    groups = [F.substring(h, at, n) for at, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _digest(block):
    return F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))


def _lines(*pairs):
    """``name: value`` lines of the pairs whose value is there."""
    return F.concat_ws(CRLF, *[F.when(F.length(v) > 0, F.concat(F.lit(f"{n}: "), v)) for n, v in pairs])


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response.

    ``responses``: ``record_id, target_uri, warc_date, ip_address, payload_digest, block_digest,
    http_headers, body`` (strings; any may be null, a null body is empty). Returns ``refers_to``
    (the response's id, unchanged), ``record_type`` (``metadata`` or ``conversion``), ``record_id``
    (from the type and the response's id, or all of the response where it has none, so reruns agree), ``target_uri``, ``warc_date``,
    ``source_payload_digest`` (the source's, or computed from the body where it has none),
    ``source_block_digest`` (null if the source has none), ``block_digest`` (of the new block),
    ``content_length`` (bytes), ``header`` (the whole WARC header) and ``block``. The metadata
    block is warc-fields: HTTP status, content type, charset (of the http headers, else the first in
    the whole body), language, title, every other http header, one line per link, and the id, size and digest
    of the conversion; what is missing has no line. Repeated responses give repeated records, an
    empty table none. One pass, no shuffle.
    """
    body = F.coalesce("body", F.lit(""))
    http = F.coalesce("http_headers", F.lit(""))
    # a line of the warc-fields must not break
    flat = lambda c: F.trim(F.regexp_replace(c, r"[\x00-\x20]+", " "))
    source = F.coalesce("record_id", F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in (
        "target_uri", "warc_date", "ip_address", "payload_digest", "block_digest")], F.sha1(http), F.sha1(body)))
    r = responses.select(
        F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "ip_address",
        F.coalesce("payload_digest", _digest(body)).alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"), plain_text(body).alias("text"),
        flat(F.regexp_extract(http, r"^HTTP/[0-9.]+ ([0-9]{3})", 1)).alias("status"),
        flat(F.regexp_extract(http, r"(?i)\nContent-Type:([^\r\n]*)", 1)).alias("mime"),
        F.when(http.rlike(CHARSET), F.regexp_extract(http, CHARSET, 1)).otherwise(F.regexp_extract(body, CHARSET, 1)).alias("charset"),
        F.filter(F.transform(F.regexp_extract_all(http, F.lit(HEADER), 1), flat),
                 lambda h: ~h.rlike("(?i)^content-type *:")).alias("http_lines"),
        F.regexp_extract(body, LANG, 1).alias("lang"),
        flat(_unescape(F.regexp_extract(body, TITLE, 1))).alias("title"),
        F.transform(F.regexp_extract_all(body, F.lit(LINK), 1), flat).alias("links"),
        record_id(source, F.lit("conversion")).alias("conversion_id"), record_id(source, F.lit("metadata")).alias("metadata_id"))
    r = r.withColumn("text_digest", _digest(F.col("text")))
    fields = F.concat_ws(
        CRLF,
        _lines(("http-status", F.col("status")), ("http-content-type", F.col("mime")), ("charset", F.col("charset")),
               ("language", F.col("lang")), ("title", F.col("title"))),
        F.array_join(F.transform("http_lines", lambda x: F.concat(F.lit("http-header: "), x)), CRLF),
        F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x)), CRLF),
        _lines(("conversion-id", F.col("conversion_id")),
               ("conversion-length", F.octet_length("text").cast("string")), ("conversion-digest", F.col("text_digest"))),
        F.lit(""))
    r = r.withColumn("fields", F.ltrim(F.regexp_replace(fields, r"(\r\n){2,}", CRLF), F.lit(CRLF)))
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"),
                 F.lit("application/warc-fields").alias("mime_out"), F.col("fields").alias("block"),
                 _digest(F.col("fields")).alias("block_digest")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"),
                 F.lit("text/plain").alias("mime_out"), F.col("text").alias("block"),
                 F.col("text_digest").alias("block_digest")))
    out = r.withColumn("d", F.explode(both)).select("*", "d.*")
    length = F.octet_length("block").cast("long")
    header = F.concat(F.lit("WARC/1.0" + CRLF), _lines(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("warc_date")), ("WARC-IP-Address", F.col("ip_address")),
        ("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        ("WARC-Source-Block-Digest", F.col("source_block_digest")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("mime_out")), ("Content-Length", length.cast("string"))), F.lit(CRLF + CRLF))
    return out.select("refers_to", "record_type", "record_id", "target_uri", "warc_date", "source_payload_digest",
                      "source_block_digest", "block_digest", length.alias("content_length"), header.alias("header"),
                      "block")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_unescape(col: str) -> str:
    for name, char in ENTITIES:
        col = f"replace({col}, {_q(name)}, {_q(char)})"
    return col


def _sql_id(kind: str) -> str:
    h = f"md5(rid || '|{kind}')"
    groups = " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])
    return f"'<urn:uuid:' || {groups} || '>'"


def _sql_flat(col: str) -> str:
    return rf"trim(regexp_replace({col}, '[\x00-\x20]+', ' ', 'g'))"


_TEXT = (f"regexp_replace(regexp_replace(regexp_replace(body, {_q(HIDDEN)}, '', 'g'), {_q(BREAKS)}, chr(10), 'g'), "
         f"{_q(TAGS)}, '', 'g')")
_SQL = rf"""
WITH src AS (
  SELECT page_id, '<urn:uuid:page-' || page_id || '>' AS rid, url, coalesce(html, '') AS body FROM pages),
parsed AS (
  SELECT *, {_sql_unescape(_TEXT)} AS raw, {_sql_flat(_sql_unescape(f"regexp_extract(body, {_q(TITLE)}, 1)"))} AS title,
         regexp_extract(body, {_q(LANG)}, 1) AS lang,
         list_transform(regexp_extract_all(body, {_q(LINK)}, 1), lambda x: {_sql_flat('x')}) AS links,
         {_sql_id('conversion')} AS cid, {_sql_id('metadata')} AS mid
  FROM src),
texts AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(raw, '[\x20\x09\x0B-\x0D\x{{00A0}}]+', ' ', 'g'),
                 ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10)) AS text
  FROM parsed),
blocks AS (
  SELECT *, 'sha1:' || sha1(text) AS text_digest,
         regexp_replace(concat_ws(chr(13) || chr(10), 'http-status: 200', 'http-content-type: text/html; charset=utf-8',
           'charset: utf-8', CASE WHEN lang <> '' THEN 'language: ' || lang END,
           CASE WHEN title <> '' THEN 'title: ' || title END,
           array_to_string(list_transform(links, lambda x: 'outlink: ' || x), chr(13) || chr(10)),
           'conversion-id: ' || cid, 'conversion-length: ' || strlen(text), 'conversion-digest: sha1:' || sha1(text), ''),
           '(\r\n){{2,}}', chr(13) || chr(10), 'g') AS fields
  FROM texts),
records AS (
  SELECT *, 'metadata' AS record_type, mid AS record_id, 'application/warc-fields' AS mime, fields AS block FROM blocks
  UNION ALL
  SELECT *, 'conversion', cid, 'text/plain', text FROM blocks)
SELECT page_id, rid AS refers_to, record_type, record_id, url AS target_uri,
       'sha1:' || sha1(body) AS source_payload_digest, 'sha1:' || sha1(block) AS block_digest,
       CAST(strlen(block) AS BIGINT) AS content_length,
       'WARC/1.0' || chr(13) || chr(10) || concat_ws(chr(13) || chr(10), 'WARC-Type: ' || record_type,
         'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || rid, CASE WHEN url <> '' THEN 'WARC-Target-URI: ' || url END,
         'WARC-Date: 2020-01-01T00:00:00Z', 'WARC-Source-Payload-Digest: sha1:' || sha1(body),
         'WARC-Block-Digest: sha1:' || sha1(block), 'Content-Type: ' || mime, 'Content-Length: ' || strlen(block))
         || chr(13) || chr(10) || chr(13) || chr(10) AS header, block
FROM records
"""


def responses_of(pages: DataFrame) -> DataFrame:
    """``pages`` as response records; the stand-in's ids carry the page id, its digests are unset."""
    none = F.lit(None).cast("string")
    return pages.select(
        F.concat(F.lit("<urn:uuid:page-"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("2020-01-01T00:00:00Z").alias("warc_date"), none.alias("ip_address"),
        none.alias("payload_digest"), none.alias("block_digest"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").alias("http_headers"),
        F.col("html").alias("body"))


@query("op7_warc", _SQL)
def op7_warc(spark, sf_dir):
    out = derivatives(responses_of(table(spark, sf_dir, "pages")))
    page = F.regexp_extract("refers_to", "page-(-?[0-9]+)>", 1).cast("long")
    return out.select(page.alias("page_id"), "refers_to", "record_type", "record_id", "target_uri",
                      "source_payload_digest", "block_digest", "content_length", "header", "block")
