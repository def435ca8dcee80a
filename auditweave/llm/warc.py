"""WARC derivatives: metadata and plain-text conversion records of archived responses.

A response gives two records. The metadata record holds title, language and outgoing links as warc-fields; the conversion
record holds the page as plain text. Both refer to the response (WARC-Refers-To, with target and date) and to each other
(WARC-Concurrent-To), keep every header of the source (as X-Source-<name>) and its payload digest, and carry digests of
their own blocks. Record ids are derived from the response's id and digest, so a rerun writes the same records. Only
DataFrame functions make them; the plan is one scan without a shuffle. ``read_warc`` reads response records of WARC files.

Edge cases: null or empty html gives an empty conversion and a metadata record without links; a null target is empty; a
page of any length is one record; repeated rows give repeated records; an empty table gives none; extra columns are
ignored, whatever their names. A script, style, noscript or template that is never closed hides the rest of the page, as
in browsers; a comment that is never closed too.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from html.entities import html5, name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.text import bind
from auditweave.llm.arrowio import bounded_batches

#: Columns of response records.
RESPONSE = ["source_id", "record_id", "target_uri", "date", "http_headers", "payload"]
#: Crawl date of responses that have none.
NO_DATE = "1970-01-01T00:00:00Z"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
UNSEEN = r"(?is)<(?:script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z)|noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|template\b[^>]*>.*?(?:</template\s*>|\z))"
LINES = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|title|head|body|html|blockquote|pre|form)\b[^>]*>"
#: A < before a blank is text, and each quote ends at its own kind.
MARKUP = r"<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANGUAGE = r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)"""
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
#: A header line of the archived response.
HEADER = r"(?m)^([!#-'*+.^-z|~A-Z0-9-]+):[ \t]*([^\r\n]*?)[ \t]*\r?$"
#: What may be a character reference; a name takes the = after it, which tells a parameter in an address from a reference.
REFERENCE = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*[;=]?)"
#: What HTML reads numbers of windows-1252's letters as, from that encoding itself, and a no-break space as a plain one.
NUMBERS = {n: ord(bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(128, 160)} | {0xA0: 0x20}
#: Names that are most of all references in pages.
FREQUENT = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "middot;", "copy;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "ndash;", "mdash;", "hellip;", "raquo;", "laquo;", "bull;", "eacute;", "egrave;", "agrave;", "ccedil;", "uuml;", "ouml;", "auml;", "szlig;", "ntilde;", "oacute;", "aacute;", "iacute;", "apos;")
#: The names that HTML resolves without a semicolon too, longest first.
OPEN_NAME = "^&(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"


def uuid_of(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def named_references() -> Column:
    """All names of HTML5 as one literal map; no-break spaces become plain ones. A map is searched from its beginning, so the names that pages have most come first."""
    old = [f"{n};" for n in name2codepoint]
    ordered = dict.fromkeys([*FREQUENT, *old, *html5])
    return F.str_to_map(F.lit("\x01".join(f"&{n}\x02{' ' if html5[n] == chr(0xA0) else html5[n]}" for n in ordered)), F.lit("\x01"), F.lit("\x02"))


def resolved(text: Column, attribute: bool = False) -> Column:
    """Character references resolved, each once and from left to right; unknown names stay.

    Numeric ones may lack the semicolon and have any number of zeros before them; as in HTML, 128 to 159 mean the letters of
    windows-1252, zero, surrogates and numbers beyond Unicode the replacement character. No-break spaces become plain ones.
    Outside attributes a name without semicolon counts even as the beginning of a longer word, as in HTML."""
    names = named_references()

    def numeric(e: Column) -> Column:
        hexadecimal = F.lower(F.substring(e, 3, 1)) == "x"
        digits = F.ltrim(F.rtrim(F.lower(e), F.lit(";")), F.lit("&#x0"))
        # nine digits are beyond Unicode in either base
        read = lambda d: F.coalesce(F.when(F.length(d) > 8, F.lit(0)).when(hexadecimal, F.conv(d, 16, 10).cast("long")).otherwise(d.try_cast("long")), F.lit(0))
        table = F.create_map(*(F.lit(x) for kv in NUMBERS.items() for x in kv))
        meant = lambda n: F.when(n.between(min(NUMBERS), max(NUMBERS)), F.try_element_at(table, n)).otherwise(n)
        letter = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return bind(bind(digits, read), lambda n: bind(meant(n), letter))

    def named(e: Column) -> Column:
        head = F.regexp_extract(e, OPEN_NAME, 0)
        begun = F.lit(None).cast("string") if attribute else F.concat(F.try_element_at(names, head), e.substr(F.length(head) + 1, F.length(e)))
        return F.coalesce(F.try_element_at(names, e), begun, e)

    def joined(found: Column) -> Column:
        distinct = F.array_distinct(found)
        known = F.map_from_arrays(distinct, F.transform(distinct, lambda e: F.when(e.startswith("&#"), numeric(e)).otherwise(named(e))))
        # one map for the text, not one for each reference
        return F.element_at(F.transform(F.array(known), lambda m: F.array_join(F.zip_with(F.split(text, REFERENCE, -1), found, lambda t, e: F.concat(t, F.coalesce(F.try_element_at(m, e), F.lit("")))), "")), 1)

    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.element_at(F.transform(F.array(found), joined), 1)).otherwise(text)


def bare_html(html: Column) -> Column:
    """Without comments and what is never shown."""
    return F.regexp_replace(F.regexp_replace(html, COMMENT, " "), UNSEEN, " ")


def tagless(bare: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(bare, LINES, "\n"), MARKUP, "")


def unquoted(value: Column) -> Column:
    return F.when(value.startswith('"') | value.startswith("'"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def tidied(text: Column) -> Column:
    """Blanks as one space (single spaces are left alone, which is most of them), lines without blanks around, no empty lines."""
    folded = lambda x, pattern, by: F.array_join(F.split(x, pattern, -1), by)  # noqa: E731  half the time of a replacement
    t = F.replace(folded(text, r"[\t\r\f\x0B][ \t\r\f\x0B]*| [ \t\r\f\x0B]+", " "), F.lit(" \n"), F.lit("\n"))
    return F.trim(folded(t, r"\n[ \n]+", "\n"), F.lit(" \n"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "), F.lit(" "))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Response records of fetched pages: source_id, record_id, target_uri, date, http_headers, payload."""
    html, url = F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).cast("long").alias("source_id"), uuid_of(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, F.sha2(html, 256)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response: source_id, record_id, type, refers_to, target_uri, content_type, content_length, block_digest, source_digest, n_links, record."""
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    html = F.col("payload")
    source = source.withColumn("bare", bare_html(html)).withColumn("tagless", tagless(F.col("bare")))  # each computed once
    links = F.transform(F.regexp_extract_all("bare", F.lit(HREF), F.lit(1)), lambda x: one_line(resolved(unquoted(x), attribute=True)))
    head = F.regexp_extract_all("http_headers", F.lit(HEADER), F.lit(0))
    kept = F.array_join(F.transform(head, lambda h: F.concat(F.lit("X-Source-"), F.regexp_replace(h, HEADER, "$1: $2\r\n"))), "")
    rows = source.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "date", kept.alias("source_headers"), digest(html).alias("source_digest"), links.alias("links"),
                         one_line(resolved(F.regexp_extract(html, TITLE, 1))).alias("title"), F.regexp_extract(html, LANGUAGE, 1).alias("language"), tidied(resolved(F.col("tagless"))).alias("text"))
    ids = {k: uuid_of(F.lit(k), "refers_to", "source_digest") for k in ("metadata", "conversion")}
    field = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))).otherwise("")
    fields = F.concat(field("title", F.col("title")), field("language", F.col("language")), F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""))
    part = lambda kind, other, kind_type, block: F.struct(F.lit(kind).alias("type"), ids[kind].alias("record_id"), ids[other].alias("other"), F.lit(kind_type).alias("content_type"), block.alias("block"))
    two = F.array(part("metadata", "conversion", "application/warc-fields", fields), part("conversion", "metadata", "text/plain; charset=UTF-8", F.col("text")))
    rows = rows.withColumn("n_links", F.size("links").cast("long")).withColumn("r", F.explode(two))
    head = [
        ("WARC-Type", F.col("r.type")), ("WARC-Record-ID", F.col("r.record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("target_uri")),
        ("WARC-Refers-To-Date", F.col("date")), ("WARC-Concurrent-To", F.col("r.other")), ("X-Source-Payload-Digest", F.col("source_digest")), ("WARC-Block-Digest", digest(F.col("r.block"))),
        ("Content-Type", F.col("r.content_type")), ("Content-Length", F.octet_length("r.block").cast("string")),
    ]
    record = F.concat(F.lit("WARC/1.1\r\n"), *(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in head), F.col("source_headers"), F.lit("\r\n"), F.col("r.block"), F.lit("\r\n\r\n"))
    return rows.select("source_id", "r.record_id", "r.type", "refers_to", "target_uri", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_digest", "n_links", record.alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Records as WARC files, one for each partition."""
    records.select(F.col("record").substr(F.lit(1), F.length("record") - 2)).write.option("lineSep", "\r\n").text(path)


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, plain or gzip, by the lengths that the records state. A record that is cut off ends the file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head.get("content-length", "0"))
            block = stream.read(size)
            if len(block) < size:
                return
            yield head, block
    except (EOFError, OSError, ValueError, zlib.error):
        return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files: source_id (null), record_id, target_uri, date, http_headers, payload, for ``derivatives``.

    A file is one value of one task, so 2 GB at most, as crawlers write them. The payload is decoded by the charset that its
    headers name, else as UTF-8, with replacement; other types of records are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for b in batches for c in b.column(0).to_pylist()):
            for head, block in records_in(content or b""):
                if head.get("warc-type", "").lower() == "response":
                    http, mark, payload = block.partition(b"\r\n\r\n")
                    http = http.decode("latin-1")
                    named = re.search(r"(?im)^content-type:.*charset=[\"']?([\w.:-]+)", http)
                    try:
                        text = payload.decode(named[1] if named else "utf-8", "replace")
                    except LookupError:
                        text = payload.decode("utf-8", "replace")
                    row = [None, head.get("warc-record-id"), head.get("warc-target-uri", "").strip("<>"), head.get("warc-date", NO_DATE), http + mark.decode(), text]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.string()) for k, v in enumerate(row)], RESPONSE)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return bounded_batches(files).mapInArrow(run, ", ".join(f"{c} {'long' if c == 'source_id' else 'string'}" for c in RESPONSE))
