"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; a validator for each format walks
the structure from there and returns its length, or nothing. The first valid medium at offset 0 gives the true type; valid
media elsewhere are carved. ``encode_text_media`` stores text bytes as 8-bit audio samples and reads them back that way.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name

UNIT, RATE = 64, 8000
#: Values that a task turns into objects, and whose results it holds, at once.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20

# ---- fixed values: magic bytes of public formats
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"RIFF": "riff",
    b"BM": "image/bmp",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
}


def _png(b: bytes, at: int) -> int:
    i, n = at + 8, len(b)
    while i + 12 <= n:
        size = int.from_bytes(b[i : i + 4], "big")
        kind = b[i + 4 : i + 8]
        if i == at + 8 and (kind != b"IHDR" or size != 13) or i + 12 + size > n:
            return 0
        if zlib.crc32(b[i + 4 : i + 8 + size]) != int.from_bytes(b[i + 8 + size : i + 12 + size], "big"):
            return 0
        i += 12 + size
        if kind == b"IEND":
            return i - at
    return 0


def _gif(b: bytes, at: int) -> int:
    n = len(b)
    if at + 13 > n:
        return 0
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < n and b[i]:
            i += 1 + b[i]
        return i + 1 if i < n else n + 1

    while i < n:
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= n:
            local = b[i + 9]
            i = blocks(i + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i, n, scanned = at + 2, len(b), False
    while i + 2 <= n:
        if b[i] != 0xFF:
            return 0
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at if scanned else 0
        if mark == 0xFF:
            i += 1
            continue
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            i += 2
            continue
        if i + 4 > n or mark < 0xC0:
            return 0
        size = int.from_bytes(b[i + 2 : i + 4], "big")
        if size < 2:
            return 0
        i += 2 + size
        if mark == 0xDA:  # entropy-coded data runs to the next marker that is no stuffing and no restart
            scanned = True
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= n:
                    return 0
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
    return 0


RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_KINDS:
        return 0
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    end, i, kinds = at + size, at + 12, []
    if end > len(b) or size < 20:
        return 0
    while i + 8 <= end:
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        kinds.append(b[i : i + 4])
        i += 8 + n + (n & 1)
    if i not in (end, end + 1) or b[at + 8 : at + 12] == b"WAVE" and not {b"fmt ", b"data"} <= set(kinds):
        return 0
    return size


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, data, head = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, depth = struct.unpack_from("<iiHH", b, at + 18)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    row = (width * depth + 31) // 32 * 4
    return size if data >= 14 + head and data + row * abs(height) <= size <= len(b) - at else 0


def _pdf(b: bytes, at: int) -> int:
    """Up to the last end mark, revisions included, whose startxref points into the document: to a table or to an object."""
    found, end = 0, at
    limit = b.find(b"%PDF-", at + 5)
    limit = len(b) if limit < 0 else limit
    while (end := b.find(b"%%EOF", end + 1, limit)) >= 0:
        ref = b.rfind(b"startxref", at, end)
        place = b[ref + 9 : end].strip() if ref >= 0 else b""
        if place.isdigit() and _xref(b, at + int(place)):
            found = end
    if not found:
        return 0
    end = found + 5
    return end - at + (2 if b[end : end + 2] == b"\r\n" else 1 if b[end : end + 1] in (b"\n", b"\r") else 0)


def _xref(b: bytes, at: int) -> bool:
    """Whether a cross-reference table or a numbered object (a cross-reference stream) begins here."""
    return at < len(b) and (b.startswith(b"xref", at) or b[at : at + 1].isdigit() and b" obj" in b[at : at + 32])


def _zip(b: bytes, at: int) -> int:
    """Up to the first end record that fits its own central directory; stored members may hold other end records."""
    end = at
    while (end := b.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        total = end + 22 + note - at
        if at + start + size == end and at + total <= len(b) and b[at + start : at + start + 4] == b"PK\x01\x02":
            return total
    return 0


def _flac(b: bytes, at: int) -> int:
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, size = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind & 0x7F or size != 34):
            return 0
        first, i = False, i + 4 + size
        if kind & 0x80:
            return max(0, _flac_frames(b, i) - at)
    return 0


def _table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << bits - 1, (1 << bits) - 1
    out = []
    for c in range(256):
        x = c << bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x & top else 0)) & mask
        out.append(x)
    return np.array(out, dtype=np.int64)


#: fixed values: the polynomials of FLAC's frame check and of Ogg's page check
FLAC_CRC, OGG_CRC = _table(16, 0x8005).tolist(), _table(32, 0x04C11DB7).tolist()


def _flac_frames(b: bytes, i: int) -> int:
    """The end of the last frame from i on: a frame runs to the first place at which its 16-bit check is 0 and the next frame
    begins, or the value or the audio ends; 0 where no frame's check fits."""
    n, at, end, crc = len(b), i, i, 0
    if b[i : i + 1] != b"\xff" or b[i + 1 : i + 2] < b"\xf8":
        return 0
    while at < n:
        crc = (crc << 8 & 0xFFFF) ^ FLAC_CRC[crc >> 8 ^ b[at]]
        at += 1
        if crc == 0 and at - end > 6:
            end = at
            if b[at : at + 1] != b"\xff" or at + 1 >= n or b[at + 1] >> 2 != 0x3E:
                return end
    return end if end > i else 0


def _ogg(b: bytes, at: int) -> int:
    """Whole pages with the right check, up to the end page of every stream that began."""
    i, live, begun = at, set(), False
    while (live or not begun) and b[i : i + 5] == b"OggS\x00" and i + 27 <= len(b):
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + size > len(b):
            return 0
        crc = 0
        for x in b[i : i + 22] + bytes(4) + b[i + 26 : i + size]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ OGG_CRC[crc >> 24 ^ x]
        if crc != int.from_bytes(b[i + 22 : i + 26], "little"):
            return 0
        stream, begun = b[i + 14 : i + 18], True
        if stream not in live and not b[i + 5] & 2:
            return 0
        live.add(stream)
        if b[i + 5] & 4:
            live.discard(stream)
        i += size
    return i - at if begun and not live else 0


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "riff": _riff, "image/bmp": _bmp,
    "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "audio/ogg": _ogg,
}


def _automaton() -> ahocorasick.Automaton:
    held = getattr(_automaton, "held", None)
    if held is None:
        held = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            held.add_word(magic.decode("latin-1"), (len(magic), kind))
        held.make_automaton()
        _automaton.held = held
    return held


def sniff(blob: bytes | None) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every outermost valid medium, in order of offset."""
    out, end = [], 0
    for stop, (n, kind) in _automaton().iter((blob or b"").decode("latin-1")):
        at = stop - n + 1
        if at >= end and (size := VALIDATORS[kind](blob, at)):
            out.append((at, size, RIFF_KINDS[blob[at + 8 : at + 12]] if kind == "riff" else kind))
            end = at + size
    return out


def in_pieces(batches: Iterator[pa.Array]) -> Iterator[list]:
    """The values of batches, a few at a time: at most PIECE_ROWS and about PIECE_BYTES, but one at least. A batch has a fixed number of
    rows, so what is made of a whole one would grow with their length."""
    for batch in batches:
        at, rows = 0, max(1, min(PIECE_ROWS, int(PIECE_BYTES * len(batch) / max(batch.nbytes, 1))))
        while at < len(batch):
            yield batch.slice(at, rows).to_pylist()
            at += rows


SNIFFED = "true_type string, media array<struct<at:long,length:long,type:string,sha256:string>>"
SEEN = pa.struct([("true_type", pa.string()), ("media", pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())])))])


def sniff_media(df: DataFrame, content_col: str = "content", declared_col: str | None = None) -> DataFrame:
    """df with true_type, media and, given a column of declared types, type_corrected.

    true_type is the type of a valid medium at offset 0, else the declared type, else null. media lists the valid media
    that lie elsewhere (embedded). Null and empty values have none. Rows stay as they are; columns with the names given here
    are replaced; an empty table gives an empty result.
    """

    @F.arrow_udf("struct<" + SNIFFED.replace(" string", ":string", 1).replace("media array", "media:array") + ">")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in in_pieces(batches):
            rows = []
            for blob in blobs:
                all_ = sniff(blob)
                found = [{"at": a, "length": n, "type": k, "sha256": hashlib.sha256(blob[a : a + n]).hexdigest()} for a, n, k in all_ if a]
                rows.append({"true_type": all_[0][2] if all_ and all_[0][0] == 0 else None, "media": found})
            yield pa.array(rows, type=SEEN)

    keep = [c for c in df.columns if c.lower() not in ("true_type", "media", "type_corrected")]
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    seen, said = free_name(df, "_seen"), free_name(df, "_declared")
    out = df.select(*keep, look(F.col(content_col)).alias(seen), declared.alias(said))
    kind = F.col(f"{seen}.true_type")
    return out.select(
        *keep,
        F.coalesce(kind, said).alias("true_type"),
        F.col(f"{seen}.media").alias("media"),
        (kind.isNotNull() & ~kind.eqNullSafe(F.col(said))).alias("type_corrected"),
    )


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; one payload byte is one sample."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(blob: bytes, found: list[tuple[int, int, str]] | None = None) -> bytes:
    """The samples of the WAV medium that sniffing finds (or found) at offset 0."""
    found = sniff(blob) if found is None else found
    if not found or found[0][0] or found[0][2] != "audio/wav":
        raise ValueError("no WAV at offset 0")
    i, end = 12, found[0][1]
    while i + 8 <= end:
        size = int.from_bytes(blob[i + 4 : i + 8], "little")
        if blob[i : i + 4] == b"data":
            return blob[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    raise ValueError("no samples")


FRAMES = 8


def sample_feature(samples: bytes) -> str:
    """Whole numbers that describe the sound: samples, how many lie in each 1/16 of the range, their sum and sum of squares (level
    and energy), crossings of the middle, and the envelope: least and greatest sample of each of eight equal frames."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x >> 4, minlength=16)
    level = int(x.sum(dtype=np.int64))
    energy = int(np.square(x, dtype=np.int64).sum())
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    frames = x.reshape(FRAMES, -1)  # samples come in units of 64
    envelope = ",".join(f"{lo}-{hi}" for lo, hi in zip(frames.min(axis=1), frames.max(axis=1), strict=True))
    return f"wav8:{len(x)}:{','.join(map(str, counts))}:{level}:{energy}:{crossings}:{envelope}"


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, embedded long"


def encode_text_media(docs: DataFrame, text_col: str = "text", with_media: bool = False) -> DataFrame:
    """docs without the text, with the stored medium's figures (and the medium itself if asked for).

    The payload is the text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64; null is empty (64 zero bytes).
    All figures come from the stored bytes as read back by sniffing. Texts that look like media are carried unchanged; equal
    texts give equal values; repeated rows stay; columns with the names given here are replaced; an empty table gives an empty
    result.
    """
    made = [x.split()[0] for x in MEDIA.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in (*made, "media") and c != text_col]
    out = MEDIA + (", media binary" if with_media else "")

    fields = [(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in MEDIA.split(", "))]
    kind = pa.struct([*fields, *([("media", pa.binary())] if with_media else [])])

    @F.arrow_udf("struct<" + ",".join(":".join(x.split(" ", 1)) for x in out.split(", ")) + ">")
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in in_pieces(batches):
            rows = []
            for text in texts:
                raw = (text or "").encode("utf-8", "surrogatepass")
                blob = to_wav(raw + bytes(UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0))
                found = sniff(blob)
                samples = wav_samples(blob, found)
                inner = sum(1 for _ in sniff(samples))
                rows.append((
                    len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(blob),
                    hashlib.sha256(blob).hexdigest(), sample_feature(samples), found[0][2], inner, *([blob] if with_media else []),
                ))
            yield pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], fields=list(kind))

    stored = free_name(docs, "_m")
    return docs.select(*keep, store(F.col(text_col)).alias(stored)).select(*keep, f"{stored}.*")
