"""Audio columns: exact round trips, and streams made to be hard to read."""

import hashlib
import random
import struct
import zlib

from tallyforge.llm.media import UNIT, crc16, header, probe_audio, read_payload, scan, store_audio, write_audio

TEXTS = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "é" * 4000, "\x00\x7f" * 3000, "z" * 200_000, "a"]


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def test_round_trip(spark):
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    stored = store_audio(docs)
    media = {r.doc_id or 0: bytes(r.media) for r in stored.collect()}
    rows = {r.doc_id or 0: r for r in probe_audio(stored).collect()}
    assert len(rows) == len(TEXTS) and media[2] == media[9]
    for i, t in enumerate(TEXTS):
        want, r = padded(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        n = len(want) // UNIT
        assert (r.duration_samples, r.sample_rate, r.crc_ok, r.crc_bad, r.resyncs, r.vbr, r.vbr_frames) == (1152 * n, 44100, n + 1, 0, 0, "xing", n)
        assert len(r.frame_offsets) == n and all(media[i][o : o + 2] == b"\xff\xfa" for o in r.frame_offsets)
    assert store_audio(docs.limit(0)).count() == 0 and probe_audio(stored.limit(0)).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: hashlib.sha256(padded(r.text)).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.payload_sha256 for r in probe_audio(store_audio(docs)).collect()} == want


def test_checksum_is_the_standard_one():
    c = 0xFFFF
    data = bytes(range(1, 22))
    for bit in (b >> s & 1 for b in data for s in range(7, -1, -1)):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    assert crc16(data) == c


def test_resynchronises_and_finds_damage():
    payload = random.Random(5).randbytes(UNIT * 9)
    media = write_audio(payload, len(payload))
    clean = scan(media)
    assert read_payload(media, clean) == payload and clean.resyncs == 0
    at = clean.offsets[4]
    hurt = bytearray(media)
    hurt[at + 8] ^= 1  # side information: the checksum must tell
    assert (scan(bytes(hurt)).crc_bad, scan(bytes(hurt)).crc_ok) == (1, 9)
    junk = b"\xff\xfb\x90\x00 not a frame \xff\xff\xff\xff ID"
    torn = media[:at] + junk + media[at:]
    found = scan(torn)
    assert found.resyncs == 1 and found.junk == len(junk) and read_payload(torn, found) == payload
    cut = media[: at + 100]
    assert len(scan(cut).offsets) == 4
    assert scan(b"").offsets == [] and scan(b"\xff" * 5000).offsets == [] and scan(b"text only").junk == 9


def test_seek_offsets_and_table():
    payload = bytes(UNIT * 50)
    media = write_audio(payload, len(payload))
    s, base = scan(media), media.index(b"\xff\xfa")
    assert s.seek(0) == s.offsets[0] and s.seek(1151) == s.offsets[0] and s.seek(1152) == s.offsets[1] and s.seek(s.samples) is None
    for i in (0, 25, 50, 99):
        want = s.offsets[i * 50 // 100] - s.offsets[0]
        assert abs(s.points[i] - base - want) <= s.vbr_bytes / 256 + s.offsets[0]


def _silent(word: bytes, n: int, table: bytes = b"") -> bytes:
    h = header(word)
    out = bytearray()
    for i in range(n):
        frame = bytearray(word + bytes(h.length - 4))
        if h.crc:
            covered = {3: h.side, 1: 16 * h.channels}.get(h.layer, 0)
            frame[4:6] = crc16(bytes(frame[2:4]) + bytes(frame[6 : 6 + covered])).to_bytes(2, "big")
        if table and not i:
            frame[36 : 36 + len(table)] = table
        out += frame
    return bytes(out)


def test_other_layers_versions_and_tags():
    for word, samples in ((b"\xff\xfe\x90\xc0", 384), (b"\xff\xfc\x90\xc0", 1152), (b"\xff\xf2\x80\xc0", 576), (b"\xff\xe2\x80\xc0", 576), (b"\xff\xfa\x90\x00", 1152)):
        s = scan(_silent(word, 5))
        assert (len(s.offsets), s.samples, s.crc_bad) == (5, 5 * samples, 0)
        assert s.crc_ok + s.crc_unread == 5
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4000, 4, 2, 1, 2, 2) + b"\0\1\0\2"
    s = scan(_silent(b"\xff\xfb\x90\xc0", 5, vbri))
    length = header(b"\xff\xfb\x90\xc0").length
    assert (s.vbr, s.vbr_bytes, s.vbr_frames, s.points, len(s.offsets)) == ("vbri", 4000, 4, [length, length + 1], 4)
    old = b"ID3\x03\0\0\0\0\0\x15" + b"TIT2" + (11).to_bytes(4, "big") + b"\0\0" + b"\0some title"
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
    s = scan(old + _silent(b"\xff\xfb\x90\xc0", 3) + ape + b"TAG" + bytes(125))
    assert s.tags == ["id3v1", "ape", "id3v2"] and s.texts == {"TIT2": "some title"} and len(s.offsets) == 3


def test_fields_of_trailing_tags_and_the_encoders_delay():
    word = b"\xff\xfb\x90\xc0"
    lame = b"Xing" + struct.pack(">III", 3, 3, 1000) + b"LAME3.100" + bytes(12) + (576 << 12 | 1100).to_bytes(3, "big")
    frames = bytearray(_silent(word, 4))
    at = 4 + header(word).side
    frames[at : at + len(lame)] = lame
    item = lambda k, v, kind=0: struct.pack("<II", len(v), kind) + k + b"\0" + v
    items = item(b"Title", "Größe".encode()) + item(b"Cover", b"\xff\xd8", 2) + item(b"Artist", b"A\0B")
    ape = items + b"APETAGEX" + struct.pack("<IIII", 2000, len(items) + 32, 3, 0) + bytes(8)
    old = b"TAG" + b"My song".ljust(30, b"\0") + b"Me".ljust(30) + bytes(30) + b"1999" + b"hello".ljust(28, b"\0") + b"\0\x07" + b"\xff"
    s = scan(bytes(frames) + ape + old)
    assert (s.delay, s.padding, s.samples, len(s.offsets), s.tags) == (576, 1100, 3 * 1152, 3, ["id3v1", "ape"])
    assert s.texts == {"id3v1:title": "My song", "id3v1:artist": "Me", "id3v1:year": "1999", "id3v1:comment": "hello", "id3v1:track": "7", "ape:Title": "Größe", "ape:Artist": "A\0B"}
    cut = struct.pack("<II", 1 << 30, 0) + b"Broken"
    assert scan(bytes(frames) + cut + b"APETAGEX" + struct.pack("<IIII", 2000, len(cut) + 32, 9, 0) + bytes(8)).tags == ["ape"]
