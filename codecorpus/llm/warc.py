"""WARC derivatives: metadata and plain-text conversion records that refer to their responses."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh

VERSION, END = "WARC/1.0", "\r\n"
#: The digits of base 32, as Spark counts in it and as digests are written (fixed values).
COUNTING, WRITTEN = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Elements that show no text, each up to its own end tag; the head after them, as scripts in it may name its end.
SILENT = "(?is)<!--.*?-->|" + "|".join(rf"<{x}[\s>].*?</{x}\s*>" for x in ("script", "style", "noscript", "template", "title"))
HEAD = r"(?is)<head[\s>].*?</head\s*>"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:\s[^>]*)?/?>"


def sha1_digest(content: Column) -> Column:
    """``sha1:`` and 32 characters of base 32: each 40 bits in turn become eight digits."""
    digits = F.sha1(content)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), COUNTING, WRITTEN))


def record_id(*parts: Column) -> Column:
    """An id that the same parts always give, in the form of a name-based UUID."""
    digits = F.md5(F.concat_ws("\n", *parts))
    groups = F.concat_ws(
        "-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.concat(F.lit("3"), F.substring(digits, 14, 3)),
        F.concat(F.lit("8"), F.substring(digits, 18, 3)), F.substring(digits, 21, 12),
    )
    return F.concat(F.lit("<urn:uuid:"), groups, F.lit(">"))


def _decode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unescape(x).replace("\xa0", " ") if x and "&" in x else x)


def plain_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or head; a line per block; all character references decoded, a fixed blank as a blank."""
    text = F.regexp_replace(F.regexp_replace(html, SILENT, " "), HEAD, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n\f]+", " "), BLOCK, "\n")
    text = F.pandas_udf(_decode, "string")(F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r" +", " "), F.lit(" \n"))


def responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages: ``warc_id, target_uri, date, http, payload, payload_digest``. Null html is an empty payload."""
    payload = F.coalesce(html_column, F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(payload), F.lit(END))
    return pages.select(
        F.col(id_column), record_id(F.lit("response"), F.col(id_column).cast("string"), F.col(url_column), sha1_digest(payload)).alias("warc_id"),
        F.col(url_column).alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), payload.alias("payload"),
        sha1_digest(payload).alias("payload_digest"),
    )


def _first(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(text, pattern, 1))


def derivatives(records: DataFrame, *keep: str) -> DataFrame:
    """Two records per response: ``warc_type, warc_id, refers_to, target_uri, date, content_type, block, block_digest, source_digest``.

    ``records``: warc_id, target_uri, date, http (status line and header lines), payload,
    payload_digest. The metadata record holds fields of the response: its HTTP status and
    headers as they came (``http-...``), payload digest and length, title, declared language,
    number of links, and the id of the conversion. The conversion record holds the payload's
    plain text. Both refer to the response and take over its target, date and digest; their
    own ids follow from its id, so the same input gives the same records, on a rerun too.

    Missing (null) payloads are empty, null headers give no lines, null targets no target. Each
    row gives two records, repeated rows too. Columns ``keep`` are handed on. One pass, no shuffle.
    """
    payload = F.coalesce("payload", F.lit(""))
    lines = F.filter(F.split(F.coalesce("http", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    status = F.element_at(F.split(F.element_at(lines, 1), " "), 2)
    headers = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("http-"), x))
    (plain,) = fresh(records, "plain")
    records = records.withColumn(plain, plain_text(payload))
    text = F.col(plain)
    converted = record_id(F.lit("conversion"), F.col("warc_id"))
    fields = F.concat(
        F.when(F.size(lines) > 0, F.array(F.concat(F.lit("http-status: "), F.coalesce(status, F.lit(""))))).otherwise(F.array().cast("array<string>")),
        headers,
        F.array(
            F.concat(F.lit("payload-digest: "), F.coalesce("payload_digest", sha1_digest(payload))),
            F.concat(F.lit("payload-length: "), F.octet_length(payload).cast("string")),
            F.concat(F.lit("title: "), _first(payload, r"(?is)<title[^>]*>([^<]*)</title")),
            F.concat(F.lit("language: "), _first(payload, r"(?i)<html[^>]*\slang=\"([^\"]*)\"")),
            F.concat(F.lit("links: "), (F.size(F.split(payload, r"(?i)<a\s[^>]*href=")) - 1).cast("string")),
            F.concat(F.lit("conversion: "), converted),
        ),
    )
    metadata = F.concat(F.array_join(fields, END), F.lit(END))
    made = F.array(
        F.struct(
            F.lit("metadata").alias("warc_type"), record_id(F.lit("metadata"), F.col("warc_id")).alias("id"),
            F.lit("application/warc-fields").alias("content_type"), metadata.alias("block"),
        ),
        F.struct(
            F.lit("conversion").alias("warc_type"), converted.alias("id"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")
        ),
    )
    digest = F.coalesce("payload_digest", sha1_digest(payload)).alias("source_digest")
    exploded = records.select(*keep, F.col("warc_id").alias("refers_to"), "target_uri", "date", digest, F.explode(made).alias("made"))
    return exploded.select(
        *keep, "made.warc_type", F.col("made.id").alias("warc_id"), "refers_to", "target_uri", "date",
        "made.content_type", "made.block", sha1_digest(F.col("made.block")).alias("block_digest"), "source_digest",
    )


def as_record(records: DataFrame) -> DataFrame:
    """``value``: each derivative as header lines, an empty line and its block."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")

    named = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "warc_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"),
    ]
    head = F.concat(F.lit(VERSION + END), *[line(k, F.col(v)) for k, v in named], line("Content-Length", F.octet_length("block").cast("string")))
    return records.select(F.concat(head, F.lit(END), "block").alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Derivatives as gzip-compressed WARC files, one per partition: each record ends with two line ends."""
    as_record(records).write.option("lineSep", END + END).option("compression", "gzip").text(path)
