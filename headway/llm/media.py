"""Media columns by signature sniffing.

One Aho-Corasick automaton of magic bytes runs over the stored bytes.  Each place it finds is given
to the validator of its format, which walks the structure (chunks, blocks, markers, frames, checksums)
and confirms it with its length or turns it down.  A valid format at the start corrects the declared
type; valid ones further on are embedded media, which can be carved out.

The validators of one value share what they have read (:class:`_Bytes`): a block or marker that one walk
has come by is not walked again from another magic, so that time grows with the length also where a very
long value is full of magic bytes.  (A gzip stream is unpacked from each gzip magic outside other media.)

Null bytes count as empty: type ``application/octet-stream``, length 0, nothing embedded.  Where magics
overlap, the first that is confirmed counts.  Repeated rows repeat; an empty table gives an empty result;
other columns pass through, those of the results' names are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import prepare, unused, without

UNKNOWN = "application/octet-stream"
RATE = 8000
UNIT = 64


def _table(polynomial: int, bits: int) -> list[int]:
    """Of each byte the remainder after it, most significant bit first."""
    out = []
    for byte in range(256):
        r = byte << bits - 8
        for _ in range(8):
            r = (r << 1) ^ (polynomial if r >> bits - 1 else 0)
        out.append(r & (1 << bits) - 1)
    return out


_CRC8, _CRC16 = _table(0x107, 8), _table(0x18005, 16)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, whose bits are in reflected order."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


_SHIFTS = [0x00800000]  # x to the power 8 * 2^i
while len(_SHIFTS) < 40:
    _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[-1]))


class _Bytes:
    """One value's bytes, with what its validators have found out."""

    STEP = 1 << 12

    def __init__(self, data: bytes):
        self.data = data
        self.walked: dict[Callable, dict] = {}
        self.found: dict[bytes, tuple[int, int]] = {}
        self.prefixes: list[int] | None = None
        self.archives: dict[int, int] | None = None

    def walk(self, step: Callable, state):
        """The end of the walk that ``step(data, state)`` goes on with: it gives the next state, or ("end", what).

        Walks that come together share their end.
        """
        known, path = self.walked.setdefault(step, {}), []
        while state not in known:
            path.append(state)
            after = step(self.data, state)
            if isinstance(after, tuple) and after[0] == "end":
                known[state] = after[1]
                break
            state = after
        end = known[state]
        known.update(dict.fromkeys(path, end))
        return end

    def find(self, what: bytes, at: int) -> int:
        """As ``bytes.find``; places between one call's start and its answer are not searched again."""
        start, place = self.found.get(what, (0, -2))
        if place == -2 or at < start or 0 <= place < at:
            place = self.data.find(what, at)
            self.found[what] = (at, place)
        return place

    def crc32(self, a: int, b: int) -> int:
        """The checksum of a part; of a long one from those of the whole's beginnings."""
        if b - a <= 16 * self.STEP:
            return zlib.crc32(memoryview(self.data)[a:b])
        if self.prefixes is None:
            self.prefixes, crc = [0], 0
            for i in range(0, len(self.data), self.STEP):
                crc = zlib.crc32(memoryview(self.data)[i : i + self.STEP], crc)
                self.prefixes.append(crc)
        up_to = lambda n: zlib.crc32(memoryview(self.data)[n // self.STEP * self.STEP : n], self.prefixes[n // self.STEP])
        crc, n = up_to(a), b - a
        for i, power in enumerate(_SHIFTS):
            if n >> i & 1:
                crc = _times(crc, power)
        return crc ^ up_to(b)

    def zip_ends(self) -> dict[int, int]:
        """Where each archive would begin by its directory's end, and its own end."""
        if self.archives is None:
            self.archives, b = {}, self.data
            p = b.find(b"PK\x05\x06")
            while 0 <= p <= len(b) - 22:
                size, start, comment = struct.unpack_from("<IIH", b, p + 12)
                if p + 22 + comment <= len(b) and p >= size + start and (not size or b[p - size : p - size + 4] == b"PK\x01\x02"):
                    self.archives.setdefault(p - size - start, p + 22 + comment)
                p = b.find(b"PK\x05\x06", p + 1)
        return self.archives


#: Forms of RIFF, their types, and the chunks that they begin with.
RIFF_FORMS = {
    b"WAVE": ("audio/wav", (b"fmt ", b"JUNK", b"bext", b"ds64", b"fact", b"LIST")),
    b"WEBP": ("image/webp", (b"VP8 ", b"VP8L", b"VP8X")),
    b"AVI ": ("video/x-msvideo", (b"LIST", b"JUNK")),
}


def _riff(own: _Bytes, at: int) -> tuple[str, int] | None:
    b = own.data
    if len(b) < at + 20:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    kind, first = RIFF_FORMS.get(b[at + 8 : at + 12], (None, ()))
    end = at + 8 + size
    if size < 4 or end > len(b) or b[at + 12 : at + 16] not in first:
        return None
    p, names = at + 12, set()
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        if not n and b[p : p + 4] in names:
            return None  # empty chunks of one name again and again
        names.add(b[p : p + 4])
        p += 8 + n + (n & 1)
    if p not in (end, end + 1) or kind == "audio/wav" and not {b"fmt ", b"data"} <= names:
        return None
    return kind, end - at


def _png(own: _Bytes, at: int) -> tuple[str, int] | None:
    b = own.data
    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None

    end = own.walk(_png_chunk(own), at + 8)
    return ("image/png", end - at) if end else None


def _png_chunk(own: _Bytes) -> Callable:
    """The step over one chunk whose checksum is right; one for all walks of a value."""
    if "png" not in own.__dict__:

        def step(b: bytes, p: int):
            if p + 12 > len(b):
                return "end", None
            n, name = struct.unpack_from(">I4s", b, p)
            end = p + 12 + n
            if end > len(b) or not name.isalpha() or own.crc32(p + 4, end - 4) != struct.unpack_from(">I", b, end - 4)[0]:
                return "end", None
            return ("end", end) if name == b"IEND" else end

        own.png = step
    return own.png


def _gif_block(b: bytes, p: int):
    """From one sub-block to the next; the end is where they end."""
    if p >= len(b) or not b[p]:
        return "end", p + 1
    return p + b[p] + 1


def _gif(own: _Bytes, at: int) -> tuple[str, int] | None:
    b = own.data
    if len(b) < at + 14:
        return None
    if "gif" not in own.__dict__:

        def step(b: bytes, p: int):
            if p >= len(b):
                return "end", None
            if b[p] == 0x3B:
                return "end", p + 1
            if b[p] == 0x21:
                return own.walk(_gif_block, p + 2)
            if b[p] == 0x2C and p + 10 < len(b):
                local = b[p + 9]
                return own.walk(_gif_block, p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
            return "end", None

        own.gif = step
    flags = b[at + 10]
    end = own.walk(own.gif, at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
    return ("image/gif", end - at) if end else None


def _jpeg_marker(b: bytes, state: tuple):
    """From one marker to the next; the state is its place and whether a scan has come."""
    p, scanned = state
    if p + 2 > len(b) or b[p] != 0xFF:
        return "end", None
    mark = b[p + 1]
    if mark == 0xD9:
        return "end", p + 2 if scanned else None
    if mark == 0xFF:
        return p + 1, scanned
    if 0xD0 <= mark <= 0xD7 or mark == 0x01:
        return p + 2, scanned
    if p + 4 > len(b) or mark < 0xC0:
        return "end", None
    size = struct.unpack_from(">H", b, p + 2)[0]
    if size < 2:
        return "end", None
    p += 2 + size
    if mark != 0xDA:
        return p, scanned
    while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
        p += 2
    return (p, True) if p >= 0 else ("end", None)


def _jpeg(own: _Bytes, at: int) -> tuple[str, int] | None:
    end = own.walk(_jpeg_marker, (at + 2, False))
    return ("image/jpeg", end - at) if end else None


def _bmp(own: _Bytes, at: int) -> tuple[str, int] | None:
    b = own.data
    if len(b) < at + 26:
        return None
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    if spare or header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= start <= size or at + size > len(b):
        return None
    return "image/bmp", size


def _pdf(own: _Bytes, at: int) -> tuple[str, int] | None:
    b = own.data
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"." and b[at + 7 : at + 8].isdigit()):
        return None
    refs = own.find(b"startxref", at)
    end = own.find(b"%%EOF", refs) if refs > 0 else -1
    return ("application/pdf", end + 5 - at) if end > 0 else None


def _gzip(own: _Bytes, at: int) -> tuple[str, int] | None:
    b = own.data
    if len(b) < at + 18 or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - at - len(d.unused_data)) if d.eof else None


def _zip(own: _Bytes, at: int) -> tuple[str, int] | None:
    end = own.zip_ends().get(at)
    return ("application/zip", end - at) if end else None


def _flac_frame(b: bytes, p: int) -> int:
    """The samples of the frame whose header stands at ``p``, 0 if none does."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return 0
    block, rate = b[p + 2] >> 4, b[p + 2] & 15
    if not block or rate == 15 or b[p + 3] >> 4 > 10:
        return 0
    lead = b[p + 4]  # a number coded as in UTF-8, of up to seven bytes
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if extra in (1, 8):
        return 0
    q = p + 4 + max(1, extra)
    coded = {6: 1, 7: 2}.get(block, 0)
    end = q + coded + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(b):
        return 0
    crc = 0
    for x in b[p:end]:
        crc = _CRC8[crc ^ x]
    if crc != b[end]:
        return 0
    if coded:
        return int.from_bytes(b[q : q + coded], "big") + 1
    return 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8


def _flac(own: _Bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames, each confirmed by its two checksums, as far as the stream's number of samples."""
    b = own.data
    if b[at + 4 : at + 8] not in (b"\0\0\0\x22", b"\x80\0\0\x22") or len(b) < at + 42:
        return None
    total = int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
    shortest = int.from_bytes(b[at + 12 : at + 15], "big")
    p = at + 4
    while True:
        if p + 4 > len(b):
            return None
        head = struct.unpack_from(">I", b, p)[0]
        p += 4 + (head & 0xFFFFFF)
        if head >> 31:
            break
    seen = 0
    while p < len(b) and (n := _flac_frame(b, p)):
        crc, end = 0, 0
        for e in range(p, len(b)):
            crc = (crc << 8 & 0xFF00) ^ _CRC16[crc >> 8 ^ b[e]]
            # The checksum of all with the checksum itself is 0; the next frame, or the last sample, confirms that.
            if not crc and e + 1 - p >= max(shortest, 8) and (seen + n >= total > 0 or e + 1 == len(b) or _flac_frame(b, e + 1)):
                end = e + 1
                break
        if not end:
            return None
        seen, p = seen + n, end
        if seen >= total > 0:
            break
    return ("audio/flac", p - at) if seen and (seen >= total or not total) else None


#: Magic bytes, and the validator of the format that they begin.
SIGNATURES = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"\x1f\x8b": _gzip,
    b"PK\x03\x04": _zip,
    b"fLaC": _flac,
}
_automaton = None


def signatures():
    """The automaton; it reads text, so bytes go through Latin-1, which maps them one to one."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, validator in SIGNATURES.items():
            _automaton.add_word(magic.decode("latin-1"), (len(magic), validator))
        _automaton.make_automaton()
    return _automaton


def sniff(data: bytes | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """The type and length of what starts at byte 0, and (type, start, length) of each embedded medium.

    Media that lie inside another embedded one are not listed: carving that one finds them.
    """
    kind, size, inside, reach = UNKNOWN, len(data or b""), [], 0
    if data:
        own = _Bytes(data)
        for last, (n, validator) in signatures().iter(data.decode("latin-1")):
            at = last + 1 - n
            if at < reach:
                continue
            found = validator(own, at)
            if not found:
                continue
            if at == 0:
                kind, size = found
            else:
                inside.append((found[0], at, found[1]))
                reach = at + found[1]
    return kind, size, inside


# The medium that payloads are stored in: 8-bit PCM, whose samples are bytes.


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples; the payload's length is even."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk."""
    p, end = 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def stored(data: bytes) -> bytes:
    """The bytes, padded to a positive multiple of 64, as WAV."""
    return to_wav(data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared and media: each whole text, padded to a positive multiple of 64 bytes, as WAV.

    Nothing is known of the stored bytes' type yet: it is declared as unknown.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for text in batch.column(1):
                data = text.as_py()
                sizes.append(len(data))
                media.append(stored(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([UNKNOWN] * len(media)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, declared string, media binary")


def scan_media(df: DataFrame, media_col: str = "media", declared_col: str | None = "declared") -> DataFrame:
    """``df`` with media_type, media_length, corrected (the declared type was another) and embedded, which
    replace columns of those names."""
    prepare(df.sparkSession)
    df = without(df, ("media_type", "media_length", "corrected", "embedded"))
    names = df.columns
    at = names.index(media_col)
    said = names.index(declared_col) if declared_col else None
    new = "media_type string, media_length long, corrected boolean, embedded array<struct<type:string,start:long,length:long>>"
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniff(m.as_py()) for m in batch.column(at)]
            old = batch.column(said).to_pylist() if said is not None else [None] * len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[0] != o for f, o in zip(found, old, strict=True)], pa.bool_()),
                    pa.array([[dict(zip(("type", "start", "length"), x, strict=True)) for x in f[2]] for f in found], kind),
                ],
                [*batch.schema.names, "media_type", "media_length", "corrected", "embedded"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + new
    return df.mapInArrow(run, schema)


def carve(scanned: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each embedded medium of ``scanned`` (as of :func:`scan_media`): carved_type, carved_start and
    carved (its bytes), which replace columns of those names, beside the other columns."""
    kept = [c for c in without(scanned, ("carved_type", "carved_start", "carved", "embedded")).columns if c != media_col]
    data, each = unused(scanned, "_media", "_each")
    rest = [F.col(f"`{c}`") for c in kept]
    found = scanned.select(*rest, F.col(media_col).alias(data), F.explode("embedded").alias(each))
    piece = F.substring(F.col(data), (F.col(f"{each}.start") + 1).cast("int"), F.col(f"{each}.length").cast("int"))
    return found.select(*rest, F.col(f"{each}.type").alias("carved_type"), F.col(f"{each}.start").alias("carved_start"), piece.alias("carved"))


def features(samples: bytes) -> str:
    """What is heard in unsigned 8-bit samples: peak and loudness in levels around the middle, crossings of the
    middle, and share of silence in thousandths; whole numbers, so that equal samples have equal features."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    n = max(1, len(x))
    loud = int(np.sqrt((x.astype(np.int64) ** 2).sum() / n))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"peak={int(np.abs(x).max(initial=0))};rms={loud};crossings={crossings};silence={1000 * int((x == -128).sum()) // n}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`store_texts` stores of each text, scanned and read back: lengths, digests and features.

    One pass: a text is stored, its type found by its signature, its samples read as that type says.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                media = stored(data := text.as_py())
                kind, size, inside = sniff(media)
                if kind != "audio/wav":
                    raise ValueError(f"stored as audio/wav, found {kind}")
                payload = from_wav(media[:size])
                feature = f"{kind};corrected={int(kind != UNKNOWN)};samples={len(payload)};{features(payload)};embedded={len(inside)};kinds={'+'.join(sorted({x[0] for x in inside}))}"
                out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds.values(), strict=True)] if out else [pa.array([], k) for k in kinds.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *kinds])

    schema = ", ".join(f"{c} {'long' if k == pa.int64() else 'string'}" for c, k in kinds.items())
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
