"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that refer to it by its identifier: ``metadata``
with what is known about the page as ``name: value`` lines, and ``conversion``
with its text. Both keep the response's target, date and headers that concern
its origin, and carry the digest of their own block beside the digest of the
response's payload. Records are rows; ``write_records`` makes files of them and
``read_records`` reads such files back, split at record borders.

Defined results: a null url or html is empty, so that a page without a body has
an empty conversion. Line breaks in a url are percent-encoded, as a header is one
line. Pages sharing number and url share identifiers, as they do
in a crawl that stores one response twice. An empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Header lines of a record in the order they are written; a null one is left out.
HEADERS = (
    ("WARC-Type", "record_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Date", "warc_date"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("WARC-Block-Digest", "block_digest"),
    ("Content-Type", "content_type"),
    ("Content-Length", "content_length"),
)

#: Elements whose content is no text of the page, and elements that end a line; fixed values.
UNSEEN = ("script", "style", "head", "nav", "footer", "noscript", "template")
LINES = "p|div|li|ul|ol|br|h[1-6]|tr|table|article|section|header|main|blockquote|pre|hr|title"
#: Named characters, in the order they are replaced; the ampersand is last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
TEXT_STEPS = (
    (r"<!--(?s:.*?)-->", " "),
    *((rf"(?is)<{name}\b.*?</{name}\s*>", " ") for name in UNSEEN),
    (rf"(?i)</?({LINES})\b[^>]*>", "\n"),
    (r"<[^>]*>", " "),
)
SPACE_STEPS = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))


def _identifier(*parts) -> Column:
    """A ``urn:uuid`` made of a digest of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    pieces = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _digest(block: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.col(block), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Pages as response records: identifier, target, date, origin headers, payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D"))
    url = F.replace(url, F.lit("\n"), F.lit("%0A"))  # a header is one line
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id"),
        _identifier(F.lit("response"), number, url).alias("record_id"),
        url.alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.lit("text/html; charset=utf-8").alias("http_content_type"),
        html.alias("payload"),
    )


def page_text(html: Column) -> Column:
    """The text of a page, a line per block, without markup."""
    text = html
    for pattern, by in TEXT_STEPS:
        text = F.regexp_replace(text, pattern, by)
    for name, by in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(by))
    for pattern, by in SPACE_STEPS:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text, F.lit(" \n"))


def _metadata(payload: str) -> Column:
    """``name: value`` lines about the response."""
    title = F.trim(
        F.regexp_replace(
            F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "
        )
    )
    lang = F.regexp_extract(payload, r"(?i)<html[^>]*\blang=\"([A-Za-z-]*)\"", 1)
    n_links = F.regexp_count(F.col(payload), F.lit(r"(?i)<a\b[^>]*\bhref="))
    lines = (
        ("title", title),
        ("html-lang", lang),
        ("outlinks", n_links.cast("string")),
        ("source-content-type", F.col("http_content_type")),
        ("source-content-length", F.octet_length(payload).cast("string")),
        ("source-payload-digest", _digest(payload)),
    )
    return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in lines])


def derivatives(source: DataFrame) -> DataFrame:
    """Two linked records for every response record.

    ``page_id, record_type, record_id, refers_to, target_uri, warc_date,
    payload_digest, block_digest, content_type, content_length, block``.
    """
    kinds = F.array(
        F.struct(
            F.lit("metadata").alias("record_type"),
            F.lit("application/warc-fields").alias("content_type"),
            _metadata("payload").alias("block"),
        ),
        F.struct(
            F.lit("conversion").alias("record_type"),
            F.lit("text/plain; charset=utf-8").alias("content_type"),
            page_text(F.col("payload")).alias("block"),
        ),
    )
    return source.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        _digest("payload").alias("payload_digest"),
        F.inline(kinds),
    ).select(
        "page_id",
        "record_type",
        _identifier("record_type", "refers_to").alias("record_id"),
        "refers_to",
        "target_uri",
        "warc_date",
        "payload_digest",
        _digest("block").alias("block_digest"),
        "content_type",
        F.octet_length("block").cast("bigint").alias("content_length"),
        "block",
    )


def header_text() -> Column:
    """Version and header lines of a record, with the empty line that ends them."""
    lines = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)))
        for name, c in HEADERS
    ]
    return F.concat(F.lit(VERSION + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def write_records(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """The records as WARC files, one per task, by Spark's own committer."""
    (
        records.select(F.concat(header_text(), F.col("block")).alias("value"))
        .write.option("lineSep", CRLF * 2)
        .option("compression", compression)
        .text(folder)
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of files that ``write_records`` made: the columns of ``HEADERS``, and ``block``.

    The reader splits at the version line after a record's end, so files of any
    size are read in splits when they are not compressed.
    """
    raw = spark.read.option("lineSep", CRLF * 2 + VERSION + CRLF).text(folder)
    # The first record of a file still has its version line, the last one its end.
    body = F.regexp_replace("value", rf"\A{VERSION}{CRLF}", "")
    ends = F.instr(F.col("body"), CRLF * 2)
    head = F.split(F.substring("body", F.lit(1), F.col("ends") - 1), CRLF)
    pairs = F.transform(
        head, lambda line: F.struct(F.substring_index(line, ": ", 1), F.regexp_replace(line, r"\A[^:]*: ", ""))
    )
    fields = raw.select(body.alias("body")).withColumn("ends", ends).select(
        F.map_from_entries(pairs).alias("h"), F.expr("substring(body, ends + 4)").alias("rest")
    )
    named = [F.col("h")[name].alias(c) for name, c in HEADERS]
    sized = fields.select(*named, "rest").withColumn(
        "content_length", F.col("content_length").cast("bigint")
    )
    whole = F.encode("rest", "UTF-8")
    block = F.decode(F.substring(whole, F.lit(1), F.col("content_length").cast("int")), "UTF-8")
    return sized.withColumn("block", block).drop("rest")


def report(pages: DataFrame) -> DataFrame:
    """The records without their blocks, and the digest of each written record."""
    record = F.concat(header_text(), F.col("block"))
    return (
        derivatives(responses(pages))
        .withColumn("n_lines", F.regexp_count("block", F.lit("\n")).cast("bigint"))
        .withColumn("record_sha256", F.sha2(record, 256))
        .drop("block", "warc_date")
    )
