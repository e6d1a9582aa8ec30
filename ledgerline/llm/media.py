"""Media columns: lossless storage of payloads, signature sniffing, type correction and carving."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import parts

BLOCK, FILLER = 576, b"\xff"
GENERAL = "application/octet-stream"
WAV_RATE = 8000


def wav_bytes(payload: bytes) -> bytes:
    """A one-channel WAV file whose 8-bit samples are the payload."""
    odd = b"\0" * (len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, WAV_RATE, WAV_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def padded(data: bytes) -> bytes:
    """data with filler bytes up to a positive multiple of BLOCK."""
    return data + FILLER * (-len(data) % BLOCK if data else BLOCK)


class Scan:
    """Bytes and what validators have found out about them, so that no stretch is walked twice.

    A validator takes the scan and where a signature starts; it gives the length of the whole object
    there, or 0 if structure or lengths are wrong. Walks that meet go on alike, whatever their starts,
    so each keeps what follows from every place it has been to.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.known: dict[tuple[str, int], object] = {}

    def walk(self, kind: str, pos: int, step: Callable[[int], tuple[int, object]], join: Callable[[object, object], object] | None = None):
        """What is at the end of a walk: step(pos) gives the next place (0 at the end) and a finding.

        The findings of all places are joined from the last to the first; without join the last counts.
        """
        path = []
        while pos and (kind, pos) not in self.known:
            after, found = step(pos)
            path.append((pos, found))
            if not after:
                last = found
                path.pop()
                self.known[kind, pos] = last
                break
            pos = after
        else:
            last = self.known.get((kind, pos))
        for place, found in reversed(path):
            last = join(found, last) if join else last
            self.known[kind, place] = last
        return last

    def ends(self, kind: str, make: Callable[[bytes], dict[int, int]]) -> dict[int, int]:
        """Starts and ends of all objects of a kind whose end marks tell their start, found once."""
        if (kind, -1) not in self.known:
            self.known[kind, -1] = make(self.data)
        return self.known[kind, -1]


def wav_length(scan: Scan, at: int) -> int:
    data = scan.data
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0

    def step(pos: int) -> tuple[int, tuple[int, int]]:
        """Ends of this chunk if it is a format and if it is data."""
        if pos + 8 > len(data):
            return 0, (0, 0)
        (size,) = struct.unpack_from("<I", data, pos + 4)
        kind, stop = data[pos : pos + 4], pos + 8 + size
        if stop > len(data):
            return 0, (0, 0)
        return stop + (size & 1), (stop * (kind == b"fmt "), stop * (kind == b"data"))

    form, samples = scan.walk("riff", at + 12, step, lambda own, later: (own[0] or later[0], own[1] or later[1])) or (0, 0)
    return end - at if 0 < form <= end and 0 < samples <= end else 0


def wav_samples(data: bytes) -> tuple[int, int]:
    """Start and end of the samples of the WAV file that data begins with."""
    pos = 12
    while data[pos : pos + 4] != b"data":
        size = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + size + (size & 1)
    return pos + 8, pos + 8 + struct.unpack_from("<I", data, pos + 4)[0]


def png_length(scan: Scan, at: int) -> int:
    data = scan.data

    def step(pos: int) -> tuple[int, int]:
        if pos + 12 > len(data):
            return 0, 0
        (size,) = struct.unpack_from(">I", data, pos)
        end = pos + 12 + size
        if end > len(data) or zlib.crc32(memoryview(data)[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return 0, 0
        return (0, end) if data[pos + 4 : pos + 8] == b"IEND" else (end, 0)

    end = scan.walk("png", at + 8, step) if data[at + 8 : at + 16] == b"\0\0\0\rIHDR" else 0
    return end - at if end else 0


def gif_length(scan: Scan, at: int) -> int:
    data = scan.data
    if at + 13 > len(data):
        return 0
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def rest(pos: int) -> tuple[int, int]:
        """Sub-blocks follow each other up to an empty one, which ends them."""
        if pos >= len(data):
            return 0, 0
        return (pos + 1 + data[pos], 0) if data[pos] else (0, pos + 1)

    def step(pos: int) -> tuple[int, int]:
        if pos >= len(data) or data[pos] not in (0x21, 0x2C, 0x3B):
            return 0, 0
        if data[pos] == 0x3B:
            return 0, pos + 1
        if data[pos] == 0x21:
            return scan.walk("gif data", pos + 2, rest) or 0, 0
        return (scan.walk("gif data", pos + 11 + table(data[pos + 9]), rest) or 0) if pos + 10 < len(data) else 0, 0

    end = scan.walk("gif", at + 13 + table(data[at + 10]), step)
    return end - at if end else 0


def jpeg_length(scan: Scan, at: int) -> int:
    data = scan.data

    def coded(pos: int) -> tuple[int, int]:
        """The next marker behind coded data: -1 less its place for the end of the image, else its place."""
        pos = data.find(b"\xff", pos)
        if pos < 0 or pos + 1 >= len(data):
            return 0, 0
        if data[pos + 1] == 0xD9:
            return 0, -1 - pos
        return (pos + 2, 0) if not data[pos + 1] or 0xD0 <= data[pos + 1] <= 0xD7 else (0, pos)

    def step(pos: int) -> tuple[int, int]:
        if pos + 4 > len(data) or data[pos] != 0xFF:
            return 0, 0
        kind, (size,) = data[pos + 1], struct.unpack_from(">H", data, pos + 2)
        if kind in (0x00, 0xFF) or size < 2:
            return 0, 0
        if kind != 0xDA:
            return pos + 2 + size, 0
        found = scan.walk("jpeg data", pos + 2 + size, coded) or 0
        return (0, 1 - found) if found < 0 else (found, 0)

    end = scan.walk("jpeg", at + 2, step)
    return end - at if end else 0


def bmp_length(scan: Scan, at: int) -> int:
    data = scan.data
    if at + 26 > len(data):
        return 0
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    if reserved or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= pixels <= size or at + size > len(data):
        return 0
    return size


#: A cross-reference table or stream, and the end of a PDF section with the offset of its cross-references.
PDF_PARTS = re.compile(rb"(?<!start)(xref)|([0-9]{1,10}\s[0-9]{1,5}\sobj)|startxref\s{1,4}([0-9]{1,12})\s{1,4}%%EOF")


def pdf_ends(data: bytes) -> dict[int, int]:
    """The last section end of each PDF: its offset, taken from the start, leads to the cross-references before it."""
    out, places = {}, (-1, -1)
    for m in PDF_PARTS.finditer(data):
        if m[1]:
            places = m.start(), places[1]
        elif m[2]:
            places = places[0], m.start()
        else:
            for place in places:
                start = place - int(m[3])
                if place >= 0 and start >= 0 and data.startswith(b"%PDF-", start):
                    out[start] = m.end()
    return out


def pdf_length(scan: Scan, at: int) -> int:
    return scan.ends("pdf", pdf_ends).get(at, at) - at


def zip_ends(data: bytes) -> dict[int, int]:
    """The end of each ZIP: an end record's sizes and offsets lead back to the start."""
    out, end = {}, data.find(b"PK\x05\x06")
    while 0 <= end <= len(data) - 22:
        size, start, note = struct.unpack_from("<IIH", data, end + 12)
        at = end - size - start
        if at >= 0 and end + 22 + note <= len(data):
            out[at] = end + 22 + note
        end = data.find(b"PK\x05\x06", end + 1)
    return out


def zip_length(scan: Scan, at: int) -> int:
    return scan.ends("zip", zip_ends).get(at, at) - at


#: Magic bytes, type and validator (fixed values of the formats).
SIGNATURES: list[tuple[bytes, str, Callable[[Scan, int], int]]] = [
    (b"RIFF", "audio/wav", wav_length),
    (b"\x89PNG\r\n\x1a\n", "image/png", png_length),
    (b"GIF87a", "image/gif", gif_length),
    (b"GIF89a", "image/gif", gif_length),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_length),
    (b"BM", "image/bmp", bmp_length),
    (b"%PDF-", "application/pdf", pdf_length),
    (b"PK\x03\x04", "application/zip", zip_length),
]


def automaton() -> ahocorasick.Automaton:
    """All magic bytes at once; a byte is the letter of its number."""
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniffed(data: bytes, magic: ahocorasick.Automaton) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """Type at the start and its length, then (type, offset, length) of what is embedded.

    Embedded objects lie behind the start, whole and valid, leftmost first without overlap.
    """
    scan = Scan(data)
    kind, length, inside, free = None, 0, [], 0
    for last, (k, size) in magic.iter(data.decode("latin-1")):
        at = last - size + 1
        if at and at < free:
            continue
        if n := SIGNATURES[k][2](scan, at):
            if at == 0:
                kind, length = SIGNATURES[k][1], n
            else:
                inside.append((SIGNATURES[k][1], at, n))
                free = at + n
    return kind, length, inside


def encode_media(docs: DataFrame, declared: Column | None = None) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text as UTF-8, padded, in a WAV file.

    Null texts are empty ones and still fill a block. Rows pass one by one, null and repeated ids
    included; other columns are left out. Without `declared` the type is the general one, as an upload's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 256):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([wav_bytes(padded(x)) for x in raw], pa.binary()), part.column("declared")], names=["doc_id", "n_bytes", "media", "declared"])

    told = F.lit(GENERAL) if declared is None else declared.cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", told.alias("declared")).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


INSPECTED = "doc_id long, n_bytes long, declared string, detected string, corrected boolean, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, embedded array<struct<type: string, offset: long, length: long>>, feature string"


def inspect_media(media: DataFrame) -> DataFrame:
    """What the bytes of (doc_id, n_bytes, media, declared) are, read from the stored form itself.

    detected is the type that signature and structure prove, null if none; corrected says that it
    isn't the declared one. Of WAV files the payload is their samples, of others the whole bytes.
    Null media are empty ones. The feature names type, samples, their sum, least and greatest, how
    many different ones there are, and embedded objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
            ("embedded", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))), ("feature", pa.string()),
        ])
        for batch in batches:
            for part in parts(batch, "media", 256):
                rows = []
                for doc_id, n_bytes, data, declared in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "declared")), strict=True):
                    data = data or b""
                    kind, _, inside = sniffed(data, magic)
                    a, b = wav_samples(data) if kind == "audio/wav" else (0, len(data))
                    payload = data[a:b]
                    seen = np.flatnonzero(np.bincount(np.frombuffer(payload, "u1"), minlength=256))
                    total = int(np.frombuffer(payload, "u1").sum(dtype="int64"))
                    feature = f"type={kind or 'unknown'};samples={len(payload)};sum={total};min={seen[0] if len(seen) else 0};max={seen[-1] if len(seen) else 0};distinct={len(seen)};embedded={len(inside)}"
                    rows.append((doc_id, n_bytes, declared, kind, kind is not None and kind != declared, len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), [dict(zip(("type", "offset", "length"), x, strict=True)) for x in inside], feature))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media", "declared").mapInArrow(run, INSPECTED)


def carve_media(media: DataFrame) -> DataFrame:
    """(doc_id, type, offset, bytes) of every embedded object; rows without any give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for doc_id, data in ((i, x) for batch in batches for part in parts(batch, "media", 256) for i, x in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True)):
            inside = sniffed(data or b"", magic)[2]
            if inside:
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(inside), pa.int64()), pa.array([x[0] for x in inside]), pa.array([x[1] for x in inside], pa.int64()), pa.array([data[a : a + n] for _, a, n in inside], pa.binary())], names=["doc_id", "type", "offset", "bytes"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, type string, offset long, bytes binary")
