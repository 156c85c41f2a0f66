"""Derivatives of web archive (WARC) responses.

Each response gives two records: ``metadata``, with the title, the links and the
headers of the source, and ``conversion``, with its plain text. Both refer to the
response by WARC-Refers-To and to each other by WARC-Concurrent-To, and keep its
target, date and payload digest; blocks have digests of their own. Record ids are
made from the source's id, so a job that runs again gives the same records.

Defined results: null and empty payloads give records with empty blocks of text;
null targets and headers are left out of the records' headers. Payloads whose
type isn't text, and records that aren't responses, give no conversion; the
latter give nothing at all. Repeated responses give repeated records. Empty
tables give no rows; extra columns are not looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Responses made from pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
NEWLINE = "\r\n"
BLANK = NEWLINE * 2
#: What stands between two records, up to the version of the second.
RECORD = f"{BLANK}WARC/1."

#: Fixed patterns, in the order in which they are applied to HTML: what they match, and what it becomes.
HTML_STEPS = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>", ""),
    (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;|&#160;", " "),
    (r"&lt;|&#60;", "<"),
    (r"&gt;|&#62;", ">"),
    (r"&quot;|&#34;", '"'),
    (r"&apos;|&#39;|&#x27;", "'"),
    (r"&copy;|&#169;", "\u00a9"),
    (r"&middot;|&#183;", "\u00b7"),
    (r"&amp;|&#38;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = r"(?i)<a\s[^>]*href=\"([^\"]*)\""


#: The block tags of HTML_STEPS, by their first letters, so that most other tags are told apart at once.
BLOCK_TAGS = (
    r"(?i)</?(?:a(?:ddress|rticle|side)|b(?:lockquote|ody|r)|d(?:[dlt]|iv)|f(?:ooter|orm)|h(?:[1-6r]|ead(?:er)?|tml)|li|main|nav|ol|p(?:re)?|section|t(?:able|[dhr]|itle)|ul)\b[^>]*>"
)
#: The entities of HTML_STEPS in their order. "&#38;" becomes "&amp;" first, so that no entity is read twice.
ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"),
    ("&copy;", "\u00a9"), ("&#169;", "\u00a9"), ("&middot;", "\u00b7"), ("&#183;", "\u00b7"), ("&#38;", "&amp;"), ("&amp;", "&"),
)


def html_text(html: Column) -> Column:
    """The text of HTML, a line for each block: what HTML_STEPS give, with fewer and cheaper passes."""
    for pattern, to in (*HTML_STEPS[:2], (BLOCK_TAGS, "\n"), HTML_STEPS[3]):
        html = F.regexp_replace(html, F.lit(pattern), F.lit(to))
    for entity, to in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(to))
    html = F.regexp_replace(html, r"[ \t\r\f]{2,}|[\t\r\f]", " ")  # single blanks stay
    return F.btrim(F.regexp_replace(html, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def record_id(*parts: Column | str) -> Column:
    """A urn made from what names the record."""
    h = F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def responses_of(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records (source, record_id, target_uri, date, http_headers, payload, payload_digest) of pages."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.octet_length(body).cast("string"))
    return pages.select(
        F.col(id_col).alias("source"), F.lit("response").alias("type"), record_id("response", F.col(id_col).cast("string"), F.coalesce(F.col(url), F.lit(""))).alias("record_id"),
        F.regexp_replace(url, r"[\r\n]+", " ").alias("target_uri"), F.lit(DATE).alias("date"), head.alias("http_headers"), body.alias("payload"), digest(body).alias("payload_digest"),
    )


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE)))


def derive(responses: DataFrame) -> DataFrame:
    """(source, record_type, record_id, refers_to, target_uri, date, payload_digest, content_type, block, block_digest, content_length, record)."""
    rows = responses.where(F.col("type") == "response").withColumn("_kind", F.lower(F.regexp_extract("http_headers", r"(?i)content-type:\s*([^\s;]*)", 1)))
    is_html, is_text = F.col("_kind").isin("text/html", "application/xhtml+xml"), F.col("_kind").startswith("text/")
    text = F.when(is_html, html_text(F.col("payload"))).otherwise(F.col("payload"))
    title = F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " ")
    line = lambda x: F.when(x.contains("\r") | x.contains("\n"), F.regexp_replace(x, r"[\r\n]+", " ")).otherwise(x)
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    source = F.concat(F.lit("http-header: "), F.regexp_replace("http_headers", r"\r?\n", f"{NEWLINE}http-header: "), F.lit(NEWLINE))
    meta = F.concat(F.lit("title: "), title, F.lit(NEWLINE), F.coalesce(source, F.lit("")), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), line(x), F.lit(NEWLINE))), ""))
    ids = [record_id(k, F.col("record_id")) for k in ("metadata", "conversion")]
    shape = lambda k, own, other, type_, block: F.struct(F.lit(k).alias("record_type"), own.alias("record_id"), other.alias("with"), F.lit(type_).alias("content_type"), block.alias("block"))
    both = F.array(
        shape("metadata", ids[0], F.when(is_html | is_text, ids[1]), "application/warc-fields", meta),
        F.when(is_html | is_text, shape("conversion", ids[1], ids[0], "text/plain; charset=utf-8", text)),
    )
    out = rows.select("source", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.explode(both).alias("r")).where("r IS NOT NULL")
    out = out.select("source", "r.record_type", "r.record_id", "refers_to", F.col("r.with").alias("concurrent_to"), "target_uri", "date", "payload_digest", "r.content_type", "r.block")
    out = out.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    head = F.concat_ws(
        "", F.lit(f"WARC/1.1{NEWLINE}"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", F.col("record_id")), _header("WARC-Date", F.col("date")), _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Refers-To", F.col("refers_to")), _header("WARC-Concurrent-To", F.col("concurrent_to")), _header("WARC-Source-Payload-Digest", F.col("payload_digest")), _header("WARC-Block-Digest", F.col("block_digest")),
        _header("Content-Type", F.col("content_type")), _header("Content-Length", F.col("content_length").cast("string")),
    )
    return out.withColumn("record", F.concat(head, F.lit(NEWLINE), F.col("block"), F.lit(NEWLINE * 2)))


def write_derivatives(records: DataFrame, path: str) -> None:
    """Writes the records as compressed WARC files, one for each partition, to any store that Spark writes to."""
    records.select(F.expr(f"substring(record, 1, length(record) - {len(NEWLINE)})").alias("value")).write.text(path, compression="gzip", lineSep=NEWLINE)


def _field(head: Column, name: str) -> Column:
    """A header's value, or null."""
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


#: Character sets of pages by the names they are given, and the ones in which they are read; others are read as UTF-8.
CHARSETS = {
    "iso-8859-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "windows-1252": "ISO-8859-1", "us-ascii": "US-ASCII", "ascii": "US-ASCII",
    "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}


def text_of(payload: Column, http_headers: Column) -> Column:
    """Bytes as text, in the character set that the headers name; those that aren't of it are replacement characters."""
    name = F.lower(F.regexp_extract(http_headers, r"(?im)^content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9_-]+)", 1))
    out = None
    for charset in sorted(set(CHARSETS.values())):
        test = name.isin(*[k for k, v in CHARSETS.items() if v == charset])
        own = F.decode(payload, charset)
        out = F.when(test, own) if out is None else out.when(test, own)
    return out.otherwise(F.make_valid_utf8(payload.cast("string")))



def _starts(pieces: pd.DataFrame) -> pd.DataFrame:
    """The first piece of the record that each piece of a file is of: records go on as far as their lengths say."""
    pieces = pieces.sort_values(["begin", "row"], ignore_index=True)
    out, first, at, end = [], 0, 0, 0
    for k, (size, want) in enumerate(zip(pieces["size"], pieces["want"], strict=True)):
        if at >= end:
            first, end = k, at + want
        out.append(first)
        at += size + len(RECORD)
    return pd.DataFrame({"source": pieces["source"], "begin": pieces["begin"], "row": pieces["row"], "first_begin": pieces["begin"].iloc[out].to_numpy(), "first_row": pieces["row"].iloc[out].to_numpy()})


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(source, head, raw) of the records of files: text up to the next begin of a record, and beyond those that a record's own content holds.

    The pieces of a record that is cut are found by an index of their sizes, a few
    bytes for each piece and a group for each file, and only these pieces are moved.
    """
    lines = spark.read.option("lineSep", RECORD).text(path).select(F.input_file_name().alias("source"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"), "value")
    head = F.substring_index("value", BLANK, 1)
    n = F.when(head.rlike(r"^(WARC/1\.)?\d+\r\n"), F.coalesce(_field(head, "Content-Length").try_cast("long"), F.lit(0)) + F.octet_length(head) + len(BLANK))
    index = lines.select("source", "begin", "row", F.octet_length("value").cast("long").alias("size"), F.coalesce(n, F.lit(0)).alias("want"))
    short = index.where("want > size").select("source").distinct()  # files in which a record goes on or is cut off
    told = index.join(short, "source", "left_semi").groupBy("source").applyInPandas(_starts, "source string, begin long, row long, first_begin long, first_row long")
    told = scratch.keep(told, "warc-index")
    own = lines.join(scratch.near(told), ["source", "begin", "row"], "left") if not told.isEmpty() else lines.withColumn("first_begin", F.lit(None).cast("long")).withColumn("first_row", F.lit(None).cast("long"))
    parts = own.where("first_row IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "row", F.hex(F.col("value").cast("binary")).alias("x")))), lambda e: e["x"]), RECORD.encode().hex())
    whole = parts.groupBy("source", "first_begin", "first_row").agg(F.unhex(joined).alias("raw")).select("source", "raw")
    all_ = own.where("first_row IS NULL").select("source", F.col("value").cast("binary").alias("raw")).union(whole)
    return all_.withColumn("head", F.substring_index(F.col("raw").cast("string"), BLANK, 1)).where(F.col("head").rlike(r"^(WARC/1\.)?\d+\r\n"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (source, type, record_id, target_uri, date, refers_to, http_headers, payload, payload_bytes, payload_digest, block_digest, truncated) of WARC files, plain or compressed.

    Files are read as text whose lines end where the next record begins, so that Spark
    streams compressed files and splits plain ones, and a task holds records, not
    files; a record goes on as far as its Content-Length says, whatever it holds.
    ``payload`` is in the character set of the HTTP headers, ``payload_bytes`` as it
    was sent. A payload without a stated digest gets the SHA-256 of its bytes.
    ``source`` is the file. A record whose file ends before its stated length is truncated.
    """
    rows = _records(spark, path)
    rows = rows.withColumn("n", F.coalesce(_field(F.col("head"), "Content-Length").try_cast("long"), F.lit(0)).cast("int"))
    rows = rows.withColumn("block", F.expr(f"substring(raw, octet_length(head) + {len(BLANK) + 1}, n)")).drop("raw")
    is_http = F.lower(F.coalesce(_field(F.col("head"), "Content-Type"), F.lit(""))).startswith("application/http")
    rows = rows.withColumn("http", F.when(is_http, F.substring_index(F.col("block").cast("string"), BLANK, 1)))
    rows = rows.withColumn("payload_bytes", F.when(is_http, F.expr(f"substring(block, octet_length(http) + {len(BLANK) + 1}, n)")).otherwise(F.col("block")))
    own = lambda name, as_: _field(F.col("head"), name).alias(as_)
    stated = F.coalesce(_field(F.col("head"), "WARC-Payload-Digest"), F.when(is_http, F.concat(F.lit("sha256:"), F.sha2("payload_bytes", 256))))
    return rows.select(
        "source", own("WARC-Type", "type"), own("WARC-Record-ID", "record_id"), own("WARC-Target-URI", "target_uri"), own("WARC-Date", "date"), own("WARC-Refers-To", "refers_to"), F.make_valid_utf8("http").alias("http_headers"),
        text_of(F.col("payload_bytes"), F.coalesce("http", F.lit(""))).alias("payload"), "payload_bytes", stated.alias("payload_digest"), own("WARC-Block-Digest", "block_digest"), (F.octet_length("block") < F.col("n")).alias("truncated"),
    )


def page_derivatives(pages: DataFrame) -> DataFrame:
    return derive(responses_of(pages))
