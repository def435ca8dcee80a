"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. A hit counts only when the
format's validator confirms structure and length (chunk walks, checksums, marker walks), so a magic that happens to occur
in other data is not taken for media. The validated type at the start corrects the declared one; validated values further
inside are carved out with offset and length, the leftmost first and none inside another.

The query stores each text as a sound or a picture, some of them inside other bytes and most under a declared type that is
wrong or says nothing; the same sniffing corrects the type and carves what is embedded, and the payload is read back from
what the validator confirmed.

Edge cases: a null value is the empty value, which has no type; repeated rows give repeated rows; of two media at one place
the first magic wins; an empty table gives an empty table; extra columns are ignored, whatever their names; a value of any
length is scanned whole, and a magic that is repeated without end costs no more than one search for what must follow it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.arrowio import bounded_batches, id_text, map_texts

#: The formats' magic bytes and the types they announce.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b".snd": "audio/basic",
    b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf",
}
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
UNKNOWN = "application/octet-stream"
ROW = 192


class Ahead:
    """Next places of byte strings in one value, asked for at ascending places, so that each is searched for once."""

    def __init__(self, value: bytes) -> None:
        self.value, self.known = value, {}

    def __call__(self, needle: bytes, at: int) -> int:
        place = self.known.get(needle, -2)
        if place == -2 or -1 < place < at:
            place = self.known[needle] = self.value.find(needle, at)
        return place


def png_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    """Chunk walk from IHDR to IEND, each checksum confirmed."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first != (kind == b"IHDR") or struct.unpack_from(">I", b, i + 8 + n)[0] != zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return None


def gif_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    """Block walk to the trailer."""
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    i = at + 13 + table(b[at + 10])
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x2C and i + 10 < len(b):
            i += 11 + table(b[i + 9])
        elif b[i] == 0x21:
            i += 2
        else:
            return None
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return None


def jpeg_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    """Marker walk; after a start of scan, to the end-of-image marker."""
    i, framed = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        marker = b[i + 1]
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if marker < 0xC0 or n < 2:
            return None
        framed |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if marker == 0xDA:
            end = ahead(b"\xff\xd9", at) if framed else -1
            end = end if end < 0 or end >= i else b.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else None
    return None


def bmp_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    """Header sizes, planes and depth must agree with the length that the header states."""
    if at + 54 > len(b):
        return None
    n, zero, start, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    fits = head in (40, 52, 56, 108, 124) and zero == 0 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 0 < width and height
    return n if fits and start >= 14 + head and start + (width * depth + 31) // 32 * 4 * abs(height) <= n <= len(b) - at else None


def riff_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    """Chunk walk that must end where the outer length ends."""
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if b[at + 8 : at + 12] not in RIFF_FORMS or end > len(b):
        return None
    i = at + 12
    while i + 8 <= end:
        n = struct.unpack_from("<I", b, i + 4)[0]
        i += 8 + n + n % 2
    return end - at if i == end and i > at + 12 else None


def au_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    if at + 24 > len(b):
        return None
    start, n, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return start + n if 24 <= start <= 4096 and 1 <= coding <= 27 and 0 < rate < 1 << 20 and 1 <= channels <= 64 and at + start + n <= len(b) else None


def gzip_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    """One member: header walked, data inflated in pieces with nothing kept, checksum and size confirmed."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, i = b[at + 3], at + 10
    if flags & 4:
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for flag in (8, 16):  # name, comment: each ends at a zero byte
        if flags & flag:
            end = ahead(b"\0", at)
            end = end if end < 0 or end >= i else b.find(b"\0", i)
            if end < 0:
                return None
            i = end + 1
    i += 2 * bool(flags & 2)
    inflater, crc, size = zlib.decompressobj(-15), 0, 0
    try:
        while i < len(b) and not inflater.eof:
            piece = inflater.unconsumed_tail or b[i : i + 65536]
            i += 0 if inflater.unconsumed_tail else len(piece)
            out = inflater.decompress(piece, 1 << 20)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    i -= len(inflater.unused_data)
    return i + 8 - at if inflater.eof and i + 8 <= len(b) and struct.unpack_from("<II", b, i) == (crc, size & 0xFFFFFFFF) else None


def pdf_length(b: bytes, at: int, ahead: Ahead) -> int | None:
    end, table = ahead(b"%%EOF", at), ahead(b"startxref", at)
    return end + 5 - at if 0 <= table < end and b[at + 5 : at + 6].isdigit() else None


VALIDATORS: dict[str, Callable[[bytes, int, Ahead], int | None]] = {
    "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "image/bmp": bmp_length, "riff": riff_length, "audio/basic": au_length, "application/gzip": gzip_length, "application/pdf": pdf_length,
}


class Sniffer:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.automaton.make_automaton()

    def __call__(self, value: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
        """Type and length of the media at the start, and what is embedded further on as (type, offset, length)."""
        kind, length, inside, free, ahead = UNKNOWN, 0, [], 0, Ahead(value)
        hits = sorted((end - n + 1, k) for end, (n, k) in self.automaton.iter(value.decode("latin-1")))
        for at, k in hits:
            if (at < free and at) or (n := VALIDATORS[k](value, at, ahead)) is None:
                continue
            k = RIFF_FORMS[value[at + 8 : at + 12]] if k == "riff" else k
            if at == 0:
                kind, length = k, n
            else:
                inside.append((k, at, n))
                free = at + n
        return kind, length, inside


class Examined(NamedTuple):
    type: str
    corrected: bool
    length: int
    carved: list[tuple[str, int, int]]


def examined(sniff: Sniffer, value: bytes, declared: str | None) -> Examined:
    """Corrected type of a value, whether the declared one was wrong, length of the media at its start, media carved from further on."""
    kind, length, inside = sniff(value)
    return Examined(kind, kind != declared, length, inside)


def sniff_media(df: DataFrame, id_col: str, value_col: str, declared_col: str) -> DataFrame:
    """Per row: detected type, whether the declared one is wrong, length of the validated media, carved parts with digests."""
    part = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        sniff = Sniffer()
        for b in batches:
            values = [v or b"" for v in b.column(1).to_pylist()]
            got = [examined(sniff, v, d) for v, d in zip(values, b.column(2).to_pylist(), strict=True)]
            carved = [[{"type": k, "offset": at, "length": n, "sha256": hashlib.sha256(v[at : at + n]).hexdigest()} for k, at, n in g.carved] for v, g in zip(values, got, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.type for g in got]), pa.array([g.corrected for g in got]), pa.array([g.length for g in got], pa.int64()), pa.array(carved, pa.list_(part))], ["id", "type", "corrected", "length", "carved"])

    rows = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("binary").alias("value"), F.col(declared_col).cast("string").alias("declared"))
    return bounded_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, type string, corrected boolean, length long, carved array<struct<type:string,offset:bigint,length:bigint,sha256:string>>")


# --- texts stored as media


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW))


def as_wav(samples: bytes) -> bytes:
    """8-bit mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples)) + samples


def as_au(samples: bytes) -> bytes:
    """8-bit linear mono."""
    return struct.pack(">4sIIIII", b".snd", 24, len(samples), 2, 8000, 1) + samples


def as_png(samples: bytes) -> bytes:
    """8-bit grey, rows of 192."""
    rows = np.zeros((len(samples) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


GREYS = b"".join(bytes([g, g, g, 0]) for g in range(256))


def as_bmp(samples: bytes) -> bytes:
    """8-bit grey palette, rows of 192 from the top."""
    start = 54 + len(GREYS)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(samples), 0, start, 40, ROW, -(len(samples) // ROW), 1, 8, 0, len(samples), 0, 0, 256, 0) + GREYS + samples


STORES: dict[str, Callable[[bytes], bytes]] = {"audio/wav": as_wav, "image/png": as_png, "audio/basic": as_au, "image/bmp": as_bmp}


def samples_of(kind: str, value: bytes) -> bytes:
    """Reads back what the stores write, from the bytes alone."""
    if kind == "audio/basic":
        start, n = struct.unpack_from(">II", value, 4)
        return value[start : start + n]
    if kind == "image/bmp":
        (start,), (width, height) = struct.unpack_from("<I", value, 10), struct.unpack_from("<ii", value, 18)
        return value[start : start + width * -height]
    if kind == "audio/wav":
        i = 12
        while value[i : i + 4] != b"data":
            n = struct.unpack_from("<I", value, i + 4)[0]
            i += 8 + n + n % 2
        return value[i + 8 : i + 8 + struct.unpack_from("<I", value, i + 4)[0]]
    i, packed, width = 8, [], 0
    while i < len(value):
        n, name = struct.unpack_from(">I4s", value, i)
        if name == b"IHDR":
            width = struct.unpack_from(">I", value, i + 8)[0]
        packed += [value[i + 8 : i + 8 + n]] * (name == b"IDAT")
        i += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


#: What a carrier holds before and behind the media: a message part's head, and a line after it.
BEFORE, BEHIND = b"Content-Transfer-Encoding: binary\r\n\r\n", b"\r\n--\r\n"


def stored(payload: bytes) -> tuple[bytes, str]:
    """The payload as media, and the type it is declared as. Format, carrier and declaration follow the payload's checksum."""
    h = zlib.crc32(payload)
    kinds = list(STORES)
    kind = kinds[h % 4]
    value = STORES[kind](payload)
    if h >> 2 & 1:  # inside other bytes
        value = BEFORE + value + BEHIND
    return value, (kind, kinds[(h + 1) % 4], UNKNOWN, "text/plain")[h >> 3 & 3]


def store_and_sniff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text stored as media, sniffed, carved where it is embedded, read back, with digests.

    feature: the corrected type, where the media begins and the length the validator confirmed, the declared type and whether
    it was wrong, and the number and types of media found in the samples themselves."""

    def make():
        sniff = Sniffer()

        def one(text: str) -> tuple:
            value, declared = stored(payload_of(text))
            found = examined(sniff, value, declared)
            kind, at, length = (found.type, 0, found.length) if found.length else found.carved[0]
            back = samples_of(kind, value[at : at + length])
            inner = sniff(back)
            inside = [k for k in [inner[0]] if k != UNKNOWN] + [k for k, _, _ in inner[2]]
            feature = f"{kind};at={at};length={length};declared={declared};corrected={int(kind != declared)};inside={len(inside)}" + "".join(f";{k}" for k in sorted(set(inside)))
            n = len(text.encode("utf-8", "surrogatepass"))
            return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(value), hashlib.sha256(value).hexdigest(), feature

        return lambda texts: list(zip(*map(one, texts), strict=True))

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(id_text(docs, id_col, text_col), make, schema, [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])
