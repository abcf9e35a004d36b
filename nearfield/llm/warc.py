"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that refer to it by its identifier: ``metadata``
(application/warc-fields: status and headers of the source, its digests, title,
language, links, and the identifier of its conversion) and ``conversion`` (text/plain).  They
are made by JVM expressions, no row leaves its task, and every pattern takes linear time.  Files
are read as bytes, record by record (``read_records``).
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: What is no text at all; an unclosed one reaches to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|title|tr|ul)\b[^<>]*>"
TAGS = r"<[a-zA-Z/!?][^<>]*>"
TITLE = r"(?is)<title[^<>]*>([^<]*)"
LANGUAGE = r"""(?i)<html[^<>]*\blang\s*=\s*["']?([a-zA-Z-]+)"""
#: A link's address, in its quotes or without any.
LINKS = r"""(?i)<a\b[^<>]*?\bhref\s*=\s*(["'][^"'<>]*["']|[^\s"'<>]+)"""
#: A reference, as it follows its "&".
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
#: The named character references of HTML 4 and XML; a no-break space is shown as a space.
NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
#: What each record starts with, but for the last digit of the version and the line's end.
VERSION = b"WARC/1."


def uuid_of(*key: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(k) for k in key]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _resolved(text: Column) -> Column:
    """Character references resolved in one pass, numeric ones and those of NAMED; others stay as they are.

    What a reference gives is never read as a part of another one.
    """
    names = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (k, v)])

    def char(r: Column) -> Column:
        digits = F.conv(F.when(F.lower(F.substring(r, 2, 1)) == "x", F.substring(r, 3, 8)).otherwise(F.conv(F.substring(r, 2, 8), 10, 16)), 16, 10).cast("int")
        valid = (digits > 0) & ~digits.between(0xD800, 0xDFFF) & (digits <= 0x10FFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
        return F.when(F.substring(r, 1, 1) == "#", F.when(valid, number).otherwise("\ufffd")).otherwise(names[r])

    whole = lambda s: F.concat(F.lit("&"), s["p"])
    read = lambda s: F.coalesce(F.concat(char(s["r"]), F.substring(s["p"], F.length(s["r"]) + 2, F.length(s["p"]))), whole(s))

    def joined(parts: Column) -> Column:
        after = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, REFERENCE, 1).alias("r")))
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(after, lambda s: F.when(s["r"] == "", whole(s)).otherwise(read(s))), ""))

    every = F.get(F.transform(F.array(F.split(text, "&")), joined), F.lit(0))
    return F.when(F.instr(text, "&") > 0, every).otherwise(text)


def _plain(text: Column) -> Column:
    text = _resolved(text)
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.trim(text, F.lit(" \n"))


def shown(html: Column) -> Column:
    """What a page shows: tags out, a line for each block; references as they stand."""
    text = F.regexp_replace(html, HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html): what a crawl's file would hold for them."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        uuid_of("response", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("null"))).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.octet_length(html).cast("string"),
        ).alias("http_headers"),
        F.col("html").cast("string").alias("payload"),
        F.col("page_id").cast("long").alias("page_id"),
    )


class Records:
    """Records of a WARC file of which the pieces between version lines come in order.

    A block is as long as its header says, whatever it holds: where it goes on beyond a version
    line within it, the pieces are joined again.  Where no end of a piece fits the length, the
    record ends at its own piece and is not whole.
    """

    def __init__(self) -> None:
        self.held: list[bytes] = []  # of a record that is longer than its first piece
        self.head: dict[str, str] = {}
        self.size = 0

    @staticmethod
    def parsed(piece: bytes) -> tuple[dict[str, str], bytes] | None:
        """Header fields by lower-case name, and what follows them; None if no record starts here."""
        at = piece.find(b"\r\n\r\n")
        if piece[:3] not in (b"0\r\n", b"1\r\n") or at < 0:
            return None
        lines = re.sub(r"\r\n[ \t]+", " ", piece[3:at].decode("utf-8", "replace")).split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        return (fields, piece[at + 4 :]) if "warc-type" in fields else None

    @staticmethod
    def length(fields: dict[str, str]) -> int | None:
        given = fields.get("content-length", "")
        return int(given) if re.fullmatch("[0-9]{1,18}", given) else None

    def made(self, fields: dict[str, str], rest: bytes) -> tuple:
        """A row: block and whether it is whole."""
        n = self.length(fields)
        whole = n is not None and n <= len(rest) <= n + 4 and not rest[n:].strip(b"\r\n")
        block = rest if n is None else rest[:n]
        named = lambda k: fields.get(k) or None
        return (
            named("warc-type"), (fields.get("warc-record-id", "").strip("<>") or None), named("warc-target-uri"), named("warc-date"), n,
            named("warc-payload-digest"), named("warc-block-digest"), block, whole,
        )

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """Rows that are complete with this piece."""
        left = [piece]
        while left:
            own = left.pop()
            if not self.held:
                found = self.parsed(own)
                if found is None:
                    continue
                n = self.length(found[0])
                if n is None or len(found[1]) >= n:
                    yield self.made(*found)
                else:
                    self.held, self.head, self.size = [own], found[0], len(found[1])
                continue
            self.held.append(own)
            self.size += len(VERSION) + len(own)
            n = self.length(self.head)
            if self.size < n:
                continue
            pieces, self.held = self.held, []
            if self.size <= n + 4:
                yield self.made(*self.parsed(VERSION.join(pieces)))
            else:
                yield self.made(*self.parsed(pieces[0]))
                left += pieces[:0:-1]

    def close(self) -> Iterator[tuple]:
        """Rows of what the end of the file leaves: cut records."""
        while self.held:
            pieces, self.held = self.held, []
            yield self.made(*self.parsed(pieces[0]))
            for piece in pieces[1:]:
                yield from self.feed(piece)


_RECORD = "record_type string, record_id string, target_uri string, date string, content_length long, payload_digest string, block_digest string, block binary, whole boolean"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip, of versions 1.0 and 1.1, as bytes.

    record_type, record_id, target_uri, date, content_length, payload_digest and block_digest
    (as the record states them), block (binary), whole.  whole is false where the block is not
    as long as its header says, or where the header says no length.  Files are split at version
    lines by Spark's reader, which keeps bytes as they are, and blocks that hold such a line are
    joined again by their length.  Only where a plain file is large enough for several tasks can
    the end of one cut such a block; that record is not whole then.  What comes before the first
    record is left out.
    """
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.binary(), pa.bool_()]
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, records, rows, size = None, Records(), [], 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(9)], names=names)
            rows.clear()
            return made

        for b in batches:
            for piece, own in zip(*b.columns, strict=True):
                if own.as_py() != file:
                    rows += records.close()
                    file = own.as_py()
                for row in records.feed(piece.as_py()):
                    rows.append(row)
                    size += len(row[7])
                    if size > 16 << 20:
                        yield out()
                        size = 0
        rows += records.close()
        yield out()

    pieces = spark.read.option("lineSep", VERSION.decode()).text(path)
    return pieces.select(F.col("value").cast("binary").alias("piece"), "_metadata.file_path").mapInArrow(run, _RECORD)


def text_of(http_headers: str, payload: bytes) -> str:
    """A payload as text: in the charset of its HTTP header or of its first kilobyte, else UTF-8; what is none becomes U+FFFD."""
    named = re.search(r"(?im)^content-type:[^\r\n]*?charset\s*=\s*[\"']?([\w.:-]+)", http_headers) or re.search(r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", payload[:1024].decode("latin-1"))
    try:
        charset = codecs.lookup(named[1]).name if named else "utf-8"
        return payload.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def responses_of(records: DataFrame) -> DataFrame:
    """Rows for derivatives(): HTTP headers and payloads of response records, whole or not.

    record_id, target_uri, date, http_headers, payload (as text), payload_digest, block_digest
    and whole.  A block without an empty line is all payload.
    """
    names = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in range(0, b.num_rows, 50):
                part, heads, texts = b.slice(cut, 50), [], []
                for block in part.column(3):
                    raw = block.as_py() or b""
                    at = raw.find(b"\r\n\r\n")
                    heads.append(raw[:at].decode("latin-1") if at >= 0 else None)
                    texts.append(text_of(heads[-1] or "", raw[at + 4 :] if at >= 0 else raw))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(heads, pa.string()), pa.array(texts, pa.string()), *part.columns[4:]], names=names)

    found = records.filter("record_type = 'response'").select("record_id", "target_uri", "date", "block", "payload_digest", "block_digest", "whole")
    return found.mapInArrow(run, "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, block_digest string, whole boolean")


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows for each row of ``found`` (record_id, target_uri, date, http_headers, payload):

    page_id (null if there is none), record_type, record_id, refers_to, target_uri, date,
    source_headers, source_digest, content_type, content_length, block_digest, block, record.
    Where found bears payload_digest, block_digest or whole, as read from files, the metadata
    state the source's own digests, and that it is cut short.
    A null or empty payload gives an empty conversion; a null URI or date leaves its header
    out; line ends within header values become a space.  Repeated rows give repeated records,
    since identifiers depend on the source's alone; an empty table gives no rows.
    """
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    if "page_id" not in found.columns:
        found = found.withColumn("page_id", F.lit(None).cast("long"))
    html = F.coalesce(F.col("payload"), F.lit(""))
    stated = [F.concat(F.lit(f"source-warc-{c.replace('_', '-')}: "), one_line(F.col(c).cast("string"))) if c in found.columns else F.lit(None).cast("string") for c in ("payload_digest", "block_digest")]
    stated.append(F.when(~F.col("whole"), F.lit("source-truncated: true")) if "whole" in found.columns else F.lit(None).cast("string"))
    # what is used more than once is a column of its own first, so it is worked out once
    parts = found.select(
        F.array(*stated).alias("stated"),
        "page_id", "target_uri", "date",
        F.col("record_id").alias("refers_to"),
        F.coalesce("http_headers", F.lit("")).alias("source_headers"),
        digest(html).alias("source_digest"),
        shown(html).alias("shown"),
        F.regexp_extract(html, TITLE, 1).alias("title"),
        F.lower(F.regexp_extract(html, LANGUAGE, 1)).alias("lang"),
        F.regexp_extract_all(html, F.lit(LINKS), 1).alias("links"),
    )
    base = parts.select(
        "page_id", "target_uri", "date", "refers_to", "source_headers", "source_digest", "lang", "stated",
        _plain(F.col("shown")).alias("text"),
        F.trim(F.regexp_replace(_plain(F.col("title")), r"\s+", " ")).alias("title"),
        F.transform("links", lambda x: F.regexp_replace(F.replace(F.trim(x, F.lit("\"'")), F.lit("&amp;"), F.lit("&")), r"\s+", "%20")).alias("links"),
    )
    conversion_id, metadata_id = (uuid_of(k, F.coalesce("refers_to", F.lit("null"))) for k in ("conversion", "metadata"))
    status = F.element_at(F.split("source_headers", CRLF), 1)
    headers = F.slice(F.split("source_headers", CRLF), 2, 1 << 20)
    fields = F.concat(
        F.array(F.concat(F.lit("source-status: "), status)),
        F.transform(headers, lambda h: F.concat(F.lit("source-header: "), h)),
        F.array(
            F.concat(F.lit("source-payload-digest: "), F.col("source_digest")),
        ),
        F.col("stated"),
        F.array(
            F.concat(F.lit("conversion: <"), conversion_id, F.lit(">")),
            F.concat(F.lit("title: "), F.col("title")),
            F.concat(F.lit("language: "), F.col("lang")),
        ),
        F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(" L a/@href"))),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), metadata_id.alias("record_id"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.array_join(fields, CRLF), F.lit(CRLF)).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), conversion_id.alias("record_id"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    rows = base.withColumn("m", F.explode(made)).select(
        "page_id", "m.record_type", "m.record_id", "refers_to", "target_uri", "date", "source_headers", "source_digest", "m.content_type",
        F.octet_length("m.block").cast("long").alias("content_length"), digest(F.col("m.block")).alias("block_digest"), "m.block",
    )
    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
        F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">")),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), one_line(F.col("target_uri"))),
        F.concat(F.lit("WARC-Refers-To-Date: "), one_line(F.col("date"))),
        F.concat(F.lit("WARC-Target-URI: "), one_line(F.col("target_uri"))),
        F.concat(F.lit("WARC-Date: "), one_line(F.col("date"))),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return rows.withColumn("record", F.concat(header, F.lit(CRLF + CRLF), F.col("block")))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzip files of whole records; the two line ends after each are the writer's separator."""
    records.select("record").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
