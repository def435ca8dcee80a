import hashlib
import re

from auditweave.llm.warc import derivatives, read_warc, responses, write_warc

PAGES = [
    (1, "http://a.example/", '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B&#233;</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t="</p>";</script><p>One <b>two</b>&nbsp;three<br>four &#x1F600; &#xD800;</p><a class="x" href="/l?a=1&amp;b=2">L</a></body></html>'),
    (2, None, None), (3, "http://b.example/", ""), (4, "u", "plain < text"), (4, "u", "plain < text"),
]


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record string")
    source = responses(df)
    rows = derivatives(source).collect()
    assert len(rows) == 2 * len(PAGES)
    one = {r.type: r for r in rows if r.source_id == 1}
    body = one["conversion"].record.split("\r\n\r\n", 1)[1].removesuffix("\r\n\r\n")
    assert body == "A & Bé\nOne two three\nfour 😀 \ufffd\nL"
    assert one["metadata"].record.split("\r\n\r\n", 1)[1] == "title: A & Bé\r\nlanguage: fr\r\noutlink: /l?a=1&b=2\r\n\r\n\r\n"
    origin = {r.source_id: r for r in source.collect()}
    for r in rows:
        head, block = r.record.split("\r\n\r\n", 1)
        block = block[:-4]
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to == origin[r.source_id].record_id
        assert int(fields["Content-Length"]) == r.content_length == len(block.encode())
        assert fields["WARC-Block-Digest"] == r.block_digest == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert fields["X-Source-Payload-Digest"] == "sha256:" + hashlib.sha256((dict((p[0], p[2]) for p in PAGES)[r.source_id] or "").encode()).hexdigest()
        assert fields["WARC-Concurrent-To"] in {x.record_id for x in rows if x.source_id == r.source_id and x.type != r.type}
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
    assert derivatives(responses(df.limit(0))).count() == 0
    write_warc(derivatives(source).coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == len(rows) and data.endswith(b"\r\n\r\n")


def test_read_back_with_all_source_headers(spark, tmp_path):
    """Files written by hand, plain and gzip, with lengths that alone tell where a record ends."""
    import gzip

    def record(kind, target, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{target}>", "WARC-Target-URI": target, "WARC-Date": "2024-05-06T07:08:09Z", **more, "Content-Length": str(len(block))}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    html = "<p>WARC/1.1\r\nWARC-Type: response\r\n\r\né</p><script>var hidden = '<p>x</p>'"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nServer:  s/1 \r\nX-Odd: a: b\r\n\r\n"
    plain = record("warcinfo", "i", b"software: x\r\n") + record("response", "http://a/", http + html.encode("latin-1")) + record("request", "http://a/", b"GET / HTTP/1.1\r\n\r\n")
    packed = gzip.compress(record("response", "http://b/", b"HTTP/1.1 204 No Content\r\n\r\n")) + gzip.compress(record("response", "http://c/", b"HTTP/1.1 200 OK\r\n\r\nc")[:-9])
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(packed)
    got = {r.target_uri: r for r in read_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {"http://a/", "http://b/"}
    assert (got["http://a/"].payload, got["http://a/"].date, got["http://b/"].payload) == (html, "2024-05-06T07:08:09Z", "")
    rows = derivatives(read_warc(spark, str(tmp_path))).filter("target_uri = 'http://a/'").collect()
    for r in rows:
        head, block = r.record.split("\r\n\r\n", 1)
        lines = head.split("\r\n")
        assert {"X-Source-Content-Type: text/html; charset=latin-1", "X-Source-Server: s/1", "X-Source-X-Odd: a: b", "WARC-Refers-To: <urn:x:http://a/>"} <= set(lines)
        assert not any("HTTP/1.1" in x for x in lines)
        if r.type == "conversion":
            assert block == "WARC/1.1\nWARC-Type: response\né\r\n\r\n"  # the script that is never closed stays hidden


def test_very_long_page_and_unclosed_elements(spark):
    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [(1, long), (2, "a<!-- never closed <p>b"), (3, "a<STYLE>b<p>c"), (4, "a<noscript>b</noscript>c<template>d"), (5, "a<script>b</style>c</script>d"), (6, "a<scripted>b")]
    got = {r.source_id: r.record.split("\r\n\r\n", 1)[1][:-4] for r in derivatives(responses(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string"))).filter("type = 'conversion'").collect()}
    assert got[1] == ("word " * 300_000).strip()
    assert [got[i] for i in range(2, 7)] == ["a", "a", "a c", "a d", "ab"]
