import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

from headway.llm import media


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def test_formats_are_confirmed_with_their_lengths():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 2) + b"xx\xff\x00yy" + b"\xff\xd9"
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
    for data, kind in ((png(), "image/png"), (gif(), "image/gif"), (media.to_wav(b"ab"), "audio/wav"), (gzip.compress(b"hello"), "application/gzip"), (z.getvalue(), "application/zip"), (jpeg, "image/jpeg"), (bmp, "image/bmp"), (b"%PDF-1.4 startxref 0 %%EOF", "application/pdf")):
        assert media.sniff(data) == (kind, len(data), []), kind
        assert media.sniff(data + b"tail")[:2] == (kind, len(data)) or kind == "application/zip"
        assert media.sniff(b"head" + data)[2] == [(kind, 4, len(data))]
        assert media.sniff(data[:-1])[0] == media.UNKNOWN, kind


def test_look_alikes_are_turned_down():
    broken = bytearray(png())
    broken[20] ^= 1
    for data in (b"BM is a name", b"GIF89a is a format", b"RIFFxxxxWAVE", bytes(broken), b"%PDF-1.4", b"PK\x03\x04", b"\xff\xd8\xff", None, b""):
        assert media.sniff(data)[0] == media.UNKNOWN and not media.sniff(data)[2]


def test_scan_corrects_and_carves(spark):
    rows = [(0, bytearray(png()), "image/jpeg"), (1, bytearray(b"__" + gif() + b"--" + png()), "image/gif"), (2, None, None)]
    scanned = media.scan_media(spark.createDataFrame(rows, "id long, media binary, declared string"))
    got = {r["id"]: r for r in scanned.collect()}
    assert got[0]["media_type"] == "image/png" and got[0]["corrected"]
    assert [e["type"] for e in got[1]["embedded"]] == ["image/gif", "image/png"]
    assert got[2]["media_type"] == media.UNKNOWN and got[2]["media_length"] == 0
    assert sorted(bytes(r["carved"]) for r in media.carve(scanned).collect()) == sorted([gif(), png()])


def test_payloads_come_back(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    got = media.text_media(odd_docs).collect()
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store_texts(odd_docs).collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest() and stored[r["doc_id"]] == media.to_wav(payload)
        assert media.features(payload) in r["feature"]
    assert media.text_media(no_docs).count() == media.scan_media(media.store_texts(no_docs)).count() == 0


def flac(frames):
    """A stream of constant frames of 192 samples, one channel of 16 bits."""

    def crc(data, table, bits):
        out = 0
        for x in data:
            out = (out << 8 & (1 << bits) - 1) ^ table[(out >> bits - 8 ^ x) & 255]
        return out

    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44) | (15 << 36) | (192 * frames)).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x80\0\0\x22" + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, k])
        head += bytes([crc(head, media._CRC8, 8)])
        frame = head + b"\x00" + struct.pack(">h", 100 + k)
        out += frame + struct.pack(">H", crc(frame, media._CRC16, 16))
    return out


def test_flac_ends_with_its_last_frame():
    data = flac(5)
    assert media.sniff(data) == ("audio/flac", len(data), [])
    assert media.sniff(data + b"and more")[:2] == ("audio/flac", len(data))
    assert media.sniff(data[:-1])[0] == media.UNKNOWN
    assert media.sniff(b"x" + data + png())[2] == [("audio/flac", 1, len(data)), ("image/png", 1 + len(data), len(png()))]


def test_long_values_full_of_magics_take_little_time():
    for magic in [*media.SIGNATURES, b"GIF89a" + b"\x01" * 8, b"%PDF-1.4 startxref", b"PK\x05\x06" + bytes(18), png()[:33] + b"\x00\x09\x00\x00IDAT", b"RIFF\x40\0\0\0WAVEfmt \0\0\0\0"]:
        data = magic * ((1 << 20) // len(magic))
        began = time.process_time()
        media.sniff(data)
        assert time.process_time() - began < 4, magic


def test_checksums_of_long_parts():
    own = media._Bytes(random.Random(3).randbytes(300_000))
    for a, b in ((0, 300_000), (5, 200_001), (4096, 299_999), (70_000, 70_001), (0, 65_537)):
        assert own.crc32(a, b) == zlib.crc32(own.data[a:b])


def test_carved_columns_replace_those_of_their_names(spark):
    rows = [(1, bytearray(b"__" + png()), "x", "y", 3)]
    scanned = media.scan_media(spark.createDataFrame(rows, "id long, media binary, _media string, carved string, _e int"), declared_col=None)
    got = media.carve(scanned).collect()
    assert bytes(got[0]["carved"]) == png() and got[0]["_media"] == "x" and got[0]["_e"] == 3
