"""Media columns: MPEG audio written and read as bytes in a DataFrame.

`store_audio` carries a payload losslessly in the ancillary data of silent
MPEG-1 Layer III frames: 576 bytes a frame, checksums on, an ID3v2 tag in
front, a variable-bitrate table in the first frame, an ID3v1 tag behind. Any
player decodes such a stream to silence.

`probe_audio` reads any MPEG audio stream of versions 1, 2 and 2.5 and layers
I to III: it skips tags and junk, resynchronises on frame headers whose
successor agrees, reads Xing, Info and VBRI tables, verifies the checksums of
layers I and III (layer II protects a part whose length depends on its bit
allocation tables; its checksums are counted, not judged), and gives the exact
duration as samples over a rate, and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices

#: Payload bytes in a frame.
UNIT = 576
# Fixed values of the MPEG audio standards: kbit/s by (version 1, layer), Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    crc: bool
    bitrate: int
    rate: int
    channels: int
    length: int
    samples: int
    side: int

    def agrees(self, other: Header) -> bool:
        """Whether both may belong to one stream: all of its frames have a checksum or none."""
        return (self.version, self.layer, self.rate, self.crc) == (other.version, other.layer, other.rate, other.crc)


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none (free-format streams included)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    speed, pitch, padding, mode = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1, word[3] >> 6
    if version is None or layer == 4 or speed in (0, 15) or pitch == 3 or word[3] & 3 == 2:
        return None
    bitrate, rate = BITRATES[version == 1, layer][speed] * 1000, RATES[version][pitch]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    channels = 1 if mode == 3 else 2
    side = 0 if layer != 3 else {(True, 1): 17, (True, 2): 32, (False, 1): 9, (False, 2): 17}[version == 1, channels]
    return Header(version, layer, not word[1] & 1, bitrate, rate, channels, length, samples, side)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = c << 1 ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_TABLE = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of the standard: polynomial 0x8005, started at 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = c << 8 & 0xFFFF ^ _TABLE[c >> 8 ^ b]
    return c


def _protected(media: bytes, at: int, h: Header) -> bytes | None:
    """What a frame's checksum covers, or None where that can't be told from the header."""
    if h.layer == 3:
        return media[at + 2 : at + 4] + media[at + 6 : at + 6 + h.side]
    if h.layer == 1:  # the bit allocation: 4 bits for each subband and channel; joint subbands share theirs
        mode = media[at + 3]
        bound = ((mode >> 4 & 3) + 1) * 4 if mode >> 6 == 1 else 32
        bits = 4 * (bound * h.channels + (32 - bound)) if h.channels == 2 else 128
        return media[at + 2 : at + 4] + media[at + 6 : at + 6 + bits // 8]
    return None


# --- writing ---------------------------------------------------------------


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3v2(texts: dict[str, str]) -> bytes:
    body = b""
    for name, value in texts.items():
        data = b"\x03" + name.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(data)) + b"\0\0" + data
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def _frame(padding: int) -> tuple[bytes, int]:
    """Everything of a mono 192 kbit/s frame at 44.1 kHz before its payload, and its length."""
    head = bytes([0xFF, 0xFA, 11 << 4 | padding << 1, 0xC0])
    h = header(head)
    side = bytes(h.side)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, h.length


_FRAMES = (_frame(0), _frame(1))
_RATE, _BITRATE = 44100, 192000


def write_audio(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries a payload of whole units; `n_bytes` of it are content."""
    body, offsets, owed = [], [], 0
    first = _FRAMES[0][1]
    size = first
    for at in range(0, len(payload), UNIT):
        owed += 144 * _BITRATE % _RATE
        padding = owed >= _RATE
        owed -= _RATE * padding
        start, length = _FRAMES[padding]
        offsets.append(size)
        body.append(start + payload[at : at + UNIT] + bytes(length - len(start) - UNIT))
        size += length
    # The table: frames, bytes and a seek point for each hundredth of the duration, as 256ths of the bytes.
    toc = bytes(min(255, 256 * offsets[i * len(offsets) // 100] // size) for i in range(100))
    start = _FRAMES[0][0]
    info = start + b"Xing" + struct.pack(">III", 7, len(offsets), size) + toc
    tag = _id3v2({"payload_bytes": str(n_bytes), "unit": str(UNIT)})
    return b"".join([tag, info, bytes(first - len(info)), *body, b"TAG" + b"payload".ljust(94, b"\0") + bytes(31)])


# --- reading ---------------------------------------------------------------


@dataclass
class Stream:
    """What a scan of a stream finds. Offsets count from the first byte of the media."""

    tags: list[str] = field(default_factory=list)
    texts: dict[str, str] = field(default_factory=dict)
    vbr: str = ""
    vbr_frames: int = 0
    vbr_bytes: int = 0
    #: Where in the stream each step of the table's clock begins: hundredths of the duration (Xing) or the table's own steps (VBRI).
    points: list[int] = field(default_factory=list)
    #: Samples that the encoder has put before and behind the sound.
    delay: int = 0
    padding: int = 0
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unread: int = 0
    resyncs: int = 0
    junk: int = 0

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def bitrates(self) -> int:
        return len({h.bitrate for h in self.headers})

    def seek(self, sample: int) -> int | None:
        """The offset of the frame that holds a sample."""
        if not self.headers or not 0 <= sample < self.samples:
            return None
        ends = np.cumsum([h.samples for h in self.headers])  # frames of another layer or version may follow a resync
        return self.offsets[int(np.searchsorted(ends, sample, side="right"))]


def _read_id3v2(media: bytes, at: int, out: Stream) -> int:
    size = 0
    for b in media[at + 6 : at + 10]:
        size = size << 7 | b & 0x7F
    end, version = min(at + 10 + size, len(media)), media[at + 3]
    pos = at + 10
    if media[at + 5] & 0x40 and version >= 3:  # an extended header
        extended = int.from_bytes(media[pos : pos + 4], "big")
        pos += extended if version == 4 else extended + 4
    while version >= 3 and pos + 10 <= end and media[pos] > 0x2F:
        raw = media[pos + 4 : pos + 8]
        n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if version == 4 else int.from_bytes(raw, "big")
        data = media[pos + 10 : min(pos + 10 + n, end)]
        if media[pos : pos + 1] == b"T" and data:
            text = data[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1"), "replace")
            name, value = media[pos : pos + 4].decode("latin-1"), text.rstrip("\0")
            if name == "TXXX":
                name, _, value = text.partition("\0")
            out.texts[name] = value.rstrip("\0")
        pos += 10 + n
    out.tags.append("id3v2")
    return at + 10 + size + 10 * bool(media[at + 5] & 0x10)


def _read_table(media: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame holds a variable-bitrate table in place of sound."""
    pos = at + 4 + 2 * h.crc + h.side
    kind = media[pos : pos + 4]
    if h.layer == 3 and kind in (b"Xing", b"Info") and pos + 8 <= at + h.length:
        flags = int.from_bytes(media[pos + 4 : pos + 8], "big")
        pos += 8
        if flags & 1:
            out.vbr_frames = int.from_bytes(media[pos : pos + 4], "big")
            pos += 4
        if flags & 2:
            out.vbr_bytes = int.from_bytes(media[pos : pos + 4], "big")
            pos += 4
        if flags & 4:
            out.points = [at + x * out.vbr_bytes // 256 for x in media[pos : pos + 100]]
            pos += 100
        pos += 4 * (flags >> 3 & 1)
        if pos + 24 <= at + h.length and media[pos : pos + 4] in (b"LAME", b"Lavf", b"Lavc"):
            both = int.from_bytes(media[pos + 21 : pos + 24], "big")
            out.delay, out.padding = both >> 12, both & 0xFFF
        out.vbr = kind.decode().lower()
        return True
    pos = at + 36
    if h.layer == 3 and media[pos : pos + 4] == b"VBRI" and pos + 26 <= at + h.length:
        out.vbr_bytes, out.vbr_frames = struct.unpack_from(">II", media, pos + 10)
        entries, scale, width = struct.unpack_from(">HHH", media, pos + 18)
        table, place = media[pos + 26 : min(pos + 26 + entries * width, at + h.length)], at + h.length
        for k in range(0, len(table) - width + 1, max(1, width)):
            out.points.append(place)
            place += scale * int.from_bytes(table[k : k + width], "big")
        out.vbr = "vbri"
        return True
    return False


#: The fields of an ID3v1 tag, and the bytes of each.
_ID3V1 = (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30))


def _tail(media: bytes, out: Stream) -> int:
    """Where the sound ends: before an ID3v1 tag and an APEv2 tag, whose fields are read."""
    end = len(media)
    if media[max(0, end - 128) :][:3] == b"TAG" and end >= 128:
        out.tags.append("id3v1")
        at = end - 125
        for name, size in _ID3V1:
            value = media[at : at + size].split(b"\0")[0].decode("latin-1").rstrip()
            if value:
                out.texts[f"id3v1:{name}"] = value
            at += size
        if media[end - 3] == 0 and media[end - 2]:
            out.texts["id3v1:track"] = str(media[end - 2])
        end -= 128
    if media[max(0, end - 32) : end][:8] == b"APETAGEX":
        size, items, flags = struct.unpack_from("<III", media, end - 20)
        out.tags.append("ape")
        at, last = max(0, end - size), end - 32
        for _ in range(items):
            name_end = media.find(b"\0", at + 8, last)
            if at + 8 > last or name_end < 0:
                break
            length, kind = struct.unpack_from("<II", media, at)
            value = media[name_end + 1 : min(name_end + 1 + length, last)]
            if kind >> 1 & 3 == 0:  # text, not a picture
                out.texts[f"ape:{media[at + 8 : name_end].decode('latin-1')}"] = value.decode("utf-8", "replace")
            at = name_end + 1 + length
        end = max(0, end - size - 32 * bool(flags >> 31))
    return end


def scan(media: bytes) -> Stream:
    """Parse a stream. Bytes that begin no frame are junk: the scan goes on at the next header whose successor, or the end, agrees."""
    out = Stream()
    end = _tail(media, out)
    at, lost = 0, False
    while at + 4 <= end:
        if media[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _read_id3v2(media, at, out)
            continue
        h = header(media[at : at + 4])
        ok = h is not None and at + h.length <= end and (not out.headers or lost or h.agrees(out.headers[-1]))
        if ok and (lost or not out.headers):
            following = header(media[at + h.length : at + h.length + 4]) if at + h.length + 4 <= end else None
            ok = at + h.length == end or following is not None and h.agrees(following) or media[at + h.length : at + h.length + 3] == b"ID3"
        if not ok:
            out.resyncs += not lost
            lost = True
            step = media.find(b"\xff", at + 1, end)
            tag = media.find(b"ID3", at + 1, step if step >= 0 else end)
            step = tag if tag >= 0 else step if step >= 0 else end
            out.junk += step - at
            at = step
            continue
        lost = False
        if h.crc:
            covered = _protected(media, at, h)
            if covered is None:
                out.crc_unread += 1
            elif crc16(covered) == int.from_bytes(media[at + 4 : at + 6], "big"):
                out.crc_ok += 1
            else:
                out.crc_bad += 1
        if out.headers or out.vbr or not _read_table(media, at, h, out):
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
        at += h.length
    out.junk += max(0, end - at)
    return out


def read_payload(media: bytes, found: Stream) -> bytes:
    """The units that `write_audio` put behind the side information."""
    out = []
    for at, h in zip(found.offsets, found.headers, strict=True):
        start = at + 4 + 2 * h.crc + h.side
        out.append(media[start : start + UNIT])
    return b"".join(out)


def feature(found: Stream) -> str:
    """The stream in one line."""
    offsets = zlib.crc32(struct.pack(f"<{len(found.offsets)}I", *found.offsets))
    return (
        f"frames={len(found.offsets)};samples={found.samples};rate={found.rate};vbr={found.vbr or '-'};bitrates={found.bitrates};"
        f"crc_ok={found.crc_ok};crc_bad={found.crc_bad};crc_unread={found.crc_unread};resyncs={found.resyncs};junk={found.junk};tags={'+'.join(found.tags) or '-'};offsets={offsets:08x}"
    )


# --- columns ---------------------------------------------------------------


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `media binary`: each whole text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576, as an audio stream.

    A null text is the empty text: one unit of filling. Equal texts give equal
    media. Every row given gives a row; an empty table gives an empty table.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            media = []
            for text in part.column(1).to_pylist():
                raw = (text or "").encode()
                media.append(write_audio(raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, media binary")


PROBE = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "sample_rate int, duration_samples long, sound_samples long, vbr string, vbr_frames long, crc_ok long, crc_bad long, resyncs long, tags array<string>, frame_offsets array<long>, seek_points array<long>, texts map<string,string>"
)


def probe_audio(audio: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parse each stream: the id column and the columns of PROBE.

    The duration is exactly `duration_samples` / `sample_rate` seconds, of
    which `sound_samples` are left without the encoder's delay and padding;
    `frame_offsets` holds where each frame of sound begins, `seek_points` the
    places of the variable-bitrate table, `texts` the text fields of ID3v2.3
    and 2.4, ID3v1 and APE tags (older ID3v2 tags and unsynchronised frames are
    passed over). `n_bytes` is the
    content length that the tag states (null without one), the payload columns
    describe what the frames carry. A null or empty stream, or one without a
    frame, has no frames, a rate of 0 and an empty payload.
    """
    names = [p.split()[0] for p in PROBE.split(", ")]
    schema = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}[p.split()[1]]) for n, p in zip(names, PROBE.split(", "), strict=True)])

    def one(media: bytes) -> tuple:
        found = scan(media)
        payload = read_payload(media, found)
        stated = found.texts.get("payload_bytes", "")
        return (
            int(stated) if stated.isdigit() else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(found),
            found.rate, found.samples, max(0, found.samples - found.delay - found.padding), found.vbr, found.vbr_frames, found.crc_ok, found.crc_bad, found.resyncs, found.tags, found.offsets, found.points, list(found.texts.items()),
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [one(m or b"") for m in part.column(1).to_pylist()]
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, *names])

    kind = audio.schema[id_col].dataType.simpleString()
    return audio.select(F.col(id_col), F.col(media_col)).mapInArrow(run, f"`{id_col}` {kind}, {PROBE}")
