"""WARC files are read by bytes: versions, lengths, charsets, digests."""

import gzip
import hashlib
from html.entities import name2codepoint

from pyspark.sql import functions as F

from nearfield.llm import warc


def record(block: bytes, version="1.1", kind="response", length=None, extra="", rid="<urn:uuid:1>"):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: http://x/\r\n{extra}Content-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def http(payload: bytes, kind="text/html"):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + payload


def read(spark, path, data: bytes):
    path.write_bytes(data)
    return warc.read_records(spark, str(path))


def test_both_versions_and_every_block(spark, tmp_path):
    blocks = [http(f"page {i}".encode()) for i in range(5)]
    data = b"".join(record(b, v) for b, v in zip(blocks, ["1.0", "1.0", "1.1", "1.0", "1.1"], strict=True))
    plain = read(spark, tmp_path / "a.warc", data).collect()
    assert [(bytes(r.block), r.whole) for r in plain] == [(b, True) for b in blocks]
    each = b"".join(gzip.compress(record(b, "1.0")) for b in blocks)  # a member a record
    assert [bytes(r.block) for r in read(spark, tmp_path / "b.warc.gz", each).collect()] == blocks


def test_blocks_that_hold_version_lines_and_bytes_of_any_kind(spark, tmp_path):
    inner = record(http(b"inner"))
    odd = [http(b"WARC/1.0\r\nWARC/1.1 and WARC/1."), inner + inner, bytes(range(256)) * 3, b"", http("caf\xe9".encode("latin-1"), "text/html; charset=ISO-8859-1")]
    rows = read(spark, tmp_path / "a.warc", b"".join(record(b) for b in odd)).collect()
    assert [(bytes(r.block), r.whole, r.content_length) for r in rows] == [(b, True, len(b)) for b in odd]


def test_records_that_are_not_whole_are_marked_and_lose_no_other(spark, tmp_path):
    good = http(b"good")
    data = b"not a record\r\n" + record(http(b"cut"), length=10**6) + record(good) + record(http(b"longer than said"), length=20) + record(good, "1.0") + record(b"", length="x") + record(good)[:-8]
    rows = read(spark, tmp_path / "a.warc", data).collect()
    assert [r.whole for r in rows] == [False, True, False, True, False, False]
    assert [bytes(r.block) for r in rows if r.whole] == [good, good] and len(rows[2].block) == 20 and rows[4].content_length is None
    found = warc.responses_of(warc.read_records(spark, str(tmp_path / "a.warc")))
    made = warc.derivatives(found).filter("record_type = 'metadata'").collect()
    assert sorted("source-truncated: true" in r.block for r in made) == [False, False, True, True, True, True]
    two = read(spark, tmp_path / "two.warc", record(http(b"x"), length=50_000) * 40).collect()
    assert len(two) == 40 and not any(r.whole for r in two)


def test_charsets_digests_and_missing_fields(spark, tmp_path):
    body = "<title>caf\xe9</title><p>\xfcber &frac12; &atilde; &Aacute; &iexcl;"
    cases = [
        http(body.encode("latin-1"), "text/html; charset=ISO-8859-1"), http(body.encode()), http(('<meta charset="windows-1252">' + body).encode("cp1252")),
        http(body.encode("utf-16-le"), 'text/html; charset="utf-16-le"'), http(body.encode(), "text/html; charset=nonsense"), http(b"\xff\xfe\xfd"), b"no header at all",
    ]
    extra = "WARC-Payload-Digest: sha1:AAA\r\nWARC-Block-Digest: sha1:BBB\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
    data = b"".join(record(c, rid=f"<urn:uuid:{i}>", extra=extra) for i, c in enumerate(cases)) + record(cases[0], rid="")
    found = warc.responses_of(read(spark, tmp_path / "a.warc", data))
    out = {(r.refers_to, r.record_type): r for r in warc.derivatives(found).collect()}
    for i in range(5):
        assert out[f"urn:uuid:{i}", "conversion"].block == "caf\xe9\n\xfcber ½ ã Á ¡", i
        assert {"title: caf\xe9", "source-warc-payload-digest: sha1:AAA", "source-warc-block-digest: sha1:BBB"} <= set(out[f"urn:uuid:{i}", "metadata"].block.split("\r\n"))
    assert out["urn:uuid:5", "conversion"].block == "�" * 3 and out["urn:uuid:6", "conversion"].block == "no header at all"
    nameless = out[None, "metadata"]
    assert "WARC-Refers-To:" not in nameless.record and "source-warc-payload-digest" not in nameless.block and nameless.block_digest == "sha256:" + hashlib.sha256(nameless.block.encode()).hexdigest()


def test_two_responses_of_one_identifier_and_clashing_names(spark):
    rows = [("urn:uuid:1", "http://a/", None, "HTTP/1.1 200 OK", "<p>a", 1), ("urn:uuid:1", "http://b/", "2020", "HTTP/1.1 404 Not Found", "<p>b", 2)]
    found = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string, page_id long")
    for name in ("shown", "title", "links", "text", "stated", "refers_to", "record_type", "m"):
        found = found.withColumn(name, F.lit(7))
    out = warc.derivatives(found).collect()
    assert len(out) == 4 and len({r.record_id for r in out}) == 2
    assert sorted(r.block for r in out if r.record_type == "conversion") == ["a", "b"]
    assert all(("WARC-Date" in r.record) == (r.page_id == 2) for r in out)


def test_every_standard_reference_is_known(spark):
    text = " ".join(f"&{n};" for n in sorted(name2codepoint) if n != "nbsp")
    got = spark.createDataFrame([(text,)], "t string").select(warc._resolved(F.col("t"))).first()[0]
    assert got == " ".join(chr(name2codepoint[n]) for n in sorted(name2codepoint) if n != "nbsp")
