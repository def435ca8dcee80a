import gzip
import hashlib
import random
import zlib

import time

from auditweave.llm.media import STORES, Sniffer, as_png, as_wav, payload_of, samples_of, sniff_media, store_and_sniff, stored

GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_round_trip_and_types():
    rnd = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000):
        payload = payload_of("".join(rnd.choices("abé日RIFF", k=n)))
        assert len(payload) % 192 == 0 and len(payload) >= 192
        for kind, store in STORES.items():
            value = store(payload)
            assert Sniffer()(value)[:2] == (kind, len(value))
            assert samples_of(kind, value) == payload


def test_false_magic_is_not_media_and_damage_is_seen():
    sniff = Sniffer()
    assert sniff(b"BM RIFF GIF89a \x89PNG\r\n\x1a\n .snd %PDF- \x1f\x8b\x08 \xff\xd8\xff") == ("application/octet-stream", 0, [])
    png = bytearray(as_png(payload_of("x")))
    png[45] ^= 1
    assert sniff(bytes(png))[0] == "application/octet-stream"


def test_carving_against_planted_parts():
    rnd = random.Random(3)
    for _ in range(50):
        parts = [rnd.choice([GIF, as_png(payload_of("a" * rnd.randint(0, 500))), as_wav(payload_of("b")), gzip.compress(b"hello" * 50)]) for _ in range(rnd.randint(1, 4))]
        value, want = b"~", []
        for p in parts:
            want.append((len(value), len(p)))
            value += p + bytes(rnd.choices(b"abc \x00", k=rnd.randint(0, 9)))
        assert [(at, n) for _, at, n in Sniffer()(value)[2]] == want


def test_queries(spark):
    texts = ["", "a", "x" * 192, "RIFF GIF89a", "é" * 4000, None, "a"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = store_and_sniff(df).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        payload = payload_of(t or "")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[1][1:] == rows[6][1:]
    assert store_and_sniff(df.limit(0)).count() == 0
    values = spark.createDataFrame([(1, GIF, "image/png"), (2, GIF, "image/gif"), (3, None, None), (4, b"zz" + GIF, "image/gif")], "k int, v binary, d string")
    got = {r.id: r for r in sniff_media(values, "k", "v", "d").collect()}
    assert (got[1].type, got[1].corrected, got[2].corrected, got[3].type, got[4].carved[0].offset) == ("image/gif", True, False, "application/octet-stream", 2)


def test_wrong_types_are_corrected_and_embedded_media_carved(spark):
    """The query's own values through the operator: every declared type is judged, every embedded part found where it is."""
    texts = [f"text {i} " * (i % 50) for i in range(300)]
    rows = []
    for i, t in enumerate(texts):
        value, declared = stored(payload_of(t))
        rows.append((i, bytearray(value), declared))
    got = {r.id: r for r in sniff_media(spark.createDataFrame(rows, "k int, v binary, d string"), "k", "v", "d").collect()}
    features = {r.doc_id: dict(x.split("=") for x in r.feature.split(";")[1:6]) | {"type": r.feature.split(";")[0]} for r in store_and_sniff(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for i, value, declared in rows:
        f, r = features[i], got[i]
        if f["at"] == "0":
            assert (r.type, r.length, r.corrected, r.carved) == (f["type"], len(value), declared != r.type, [])
        else:
            assert r.type == "application/octet-stream" and [(c.type, c.offset, c.length) for c in r.carved] == [(f["type"], int(f["at"]), int(f["length"]))]
        assert f["declared"] == declared and f["corrected"] == str(int(declared != f["type"]))
        seen.add((f["type"], f["at"] != "0", f["corrected"]))
    assert len(seen) == 16


def test_repeated_magic_is_linear():
    sniff = Sniffer()
    for unit in (b"%PDF-1 ", b"\x1f\x8b\x08\x1f", b"\x1f\x8b\x08\x08AAAAAA", b"GIF89a", b"\xff\xd8\xff\xda\x00\x02", b"%PDF-1 startxref "):
        began = time.time()
        assert sniff(unit * (1_000_000 // len(unit))) == ("application/octet-stream", 0, [])
        assert time.time() - began < 20, unit


def test_pdf_and_gzip_lengths():
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    named = gzip.compress(b"abc" * 1000)
    named = named[:3] + b"\x08" + named[4:10] + b"name\x00" + named[10:]
    value = b"junk %PDF- " + pdf + b" %PDF-9 %%EOF " + named + b" tail"
    assert [(k, n) for k, _, n in Sniffer()(value)[2]][1:] == [("application/gzip", len(named))]
    assert Sniffer()(pdf + b"..")[:2] == ("application/pdf", len(pdf))
    assert Sniffer()(named[:-3])[1] == 0
