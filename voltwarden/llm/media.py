"""MPEG audio in media columns: writing streams that carry a payload, and reading any stream robustly.

A stream is an ID3v2 tag, a frame with a Xing table (frames, bytes, a seek table), frames of MPEG-1 Layer III with a
checksum each, and an ID3v1 tag. The payload's bytes are the frames' main data, the format's own unit: frames at two bit
rates, the larger ones first, the last ones at the smallest rate that holds what is left.

Reading starts from nothing but bytes: it skips tags, finds the first header that others follow, and where the next
header is not in its place it searches on for the next one that is confirmed by the header after it. Durations are exact:
samples of the frames found over the sampling rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the format: kbit/s by index for MPEG-1 and MPEG-2/2.5, layers I, II, III; sampling rates by index.
RATES_1 = {
    1: [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    2: [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    3: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
}
RATES_2 = {
    1: [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    3: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLING = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
#: Written here: Layer III at 32 kHz, mono, whose frames are a whole number of bytes (4.5 times the rate in kbit/s).
HZ, SAMPLES, SIDE = 32000, 1152, 17


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hz: int
    padding: int
    mode: int  # 3: mono

    @cached_property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 3 else 1152

    @cached_property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.hz + self.padding) * 4
        return self.samples // 8 * self.kbps * 1000 // self.hz + self.padding

    @cached_property
    def side(self) -> int:
        """Bytes of side information, which a Layer III checksum covers with the header's last two bytes."""
        if self.layer != 3:
            return 0
        return (17 if self.mode == 3 else 32) if self.version == 3 else (9 if self.mode == 3 else 17)


def parse_header(raw: bytes, at: int = 0) -> Header | None:
    """The frame header at a place; None where there is none. Free-format frames (rate index 0) are not read."""
    return _header(raw[at : at + 4])


@lru_cache(maxsize=4096)
def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    kbps = (RATES_1 if version == 3 else RATES_2)[layer][rate]
    return Header(version, layer, not raw[1] & 1, kbps, SAMPLING[version][hz], raw[2] >> 1 & 1, raw[3] >> 6)


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first, by byte."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ CRC[(crc >> 8) ^ column]
    return crc


def _frame(kbps: int) -> int:
    return SAMPLES // 8 * kbps * 1000 // HZ


def _frames(payload: bytes, kbps: int) -> bytes:
    """Frames at one rate over the payload; the last is filled with zeros."""
    size, room = _frame(kbps), _frame(kbps) - 6 - SIDE
    n = -(-len(payload) // room)
    out = np.zeros((n, size), np.uint8)
    out[:, :4] = [0xFF, 0xFA, RATES_1[3].index(kbps) << 4 | SAMPLING[3].index(HZ) << 2, 0xC4]
    crc = crc16(out[:, [2, 3, *range(6, 6 + SIDE)]])
    out[:, 4], out[:, 5] = crc >> 8, crc & 255
    body = np.zeros(n * room, np.uint8)
    body[: len(payload)] = np.frombuffer(payload, np.uint8)
    out[:, 6 + SIDE :] = body.reshape(n, room)
    return out.tobytes()


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag_frame(name: str, body: bytes) -> bytes:
    return name.encode() + _synchsafe(len(body)) + b"\0\0" + body


def encode(payload: bytes, title: str = "payload", wide: int = 320) -> bytes:
    """A stream that holds the payload; payload_of() gives it back."""
    room = _frame(wide) - 6 - SIDE
    whole = len(payload) // room * room
    rest = payload[whole:]
    small = next((r for r in RATES_1[3][1:] if _frame(r) - 6 - SIDE >= len(rest)), wide)
    audio = _frames(payload[:whole], wide) + (_frames(rest, small) if rest else b"")
    frames = whole // room + bool(rest)
    ends = np.minimum(np.arange(100) * max(1, frames) // 100, frames) * _frame(wide)
    total = len(audio) + _frame(64)
    toc = np.minimum(255, (ends + _frame(64)) * 256 // max(1, total)).astype(np.uint8).tobytes()
    info = np.zeros(_frame(64), np.uint8)
    info[:4] = [0xFF, 0xFB, RATES_1[3].index(64) << 4 | SAMPLING[3].index(HZ) << 2, 0xC4]
    table = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    info[4 + SIDE : 4 + SIDE + len(table)] = np.frombuffer(table, np.uint8)
    tags = _tag_frame("TIT2", b"\3" + title.encode()) + _tag_frame("TXXX", b"\3payload_bytes\0" + str(len(payload)).encode())
    return b"ID3\4\0\0" + _synchsafe(len(tags)) + tags + info.tobytes() + audio + b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(94) + b"\xff"


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    v1: dict[str, str] = field(default_factory=dict)
    headers: list[Header] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    vbr: dict | None = None
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes that belong to no tag and no frame

    @property
    def duration(self) -> Fraction:
        """Seconds, exact, of the frames but for the one that holds the table."""
        samples: dict[int, int] = {}
        for h in self.headers:
            samples[h.hz] = samples.get(h.hz, 0) + h.samples
        return sum((Fraction(n, hz) for hz, n in samples.items()), Fraction(0))


def _id3v2(raw: bytes, at: int) -> tuple[int, dict[str, str]] | None:
    """The end of a tag at a place, and its text frames; frames that don't parse end the reading of the tag."""
    if raw[at : at + 3] != b"ID3" or at + 10 > len(raw) or max(raw[at + 6 : at + 10]) > 127:
        return None
    size = 0
    for b in raw[at + 6 : at + 10]:
        size = size << 7 | b
    major, flags, found, p = raw[at + 3], raw[at + 5], {}, 0
    end, tag = at + 10 + size + (10 if flags & 16 else 0), raw[at + 10 : at + 10 + size]
    codes = ["latin-1", "utf-16", "utf-16-be", "utf-8"]
    if flags & 128 and major < 4:  # a zero stands behind each 0xff
        tag = tag.replace(b"\xff\0", b"\xff")
    if flags & 64 and major >= 3:  # an extended header; its size counts itself from version 4 on
        p = int.from_bytes(tag[:4], "big") + 4 if major == 3 else sum(b << 7 * (3 - i) for i, b in enumerate(tag[:4]))
    wide = 3 if major == 2 else 4  # letters of a name, bytes of a size
    head = 6 if major == 2 else 10
    while major in (2, 3, 4) and p + head <= len(tag) and tag[p]:
        n = 0
        for b in tag[p + wide : p + 2 * wide]:
            n = n << (7 if major == 4 else 8) | b
        name, body = tag[p : p + wide].decode("latin-1"), tag[p + head : p + head + n]
        if name.startswith("T") and body and body[0] < 4:
            text = body[1:].decode(codes[body[0]], "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            found[key] = value
        p += head + n
    return min(end, len(raw)), found


def _vbr(raw: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at a place."""
    p = at + 4 + 2 * h.protected + h.side
    if raw[p : p + 4] in (b"Xing", b"Info"):
        flags, out, q = int.from_bytes(raw[p + 4 : p + 8], "big"), {"kind": raw[p : p + 4].decode()}, p + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], q = int.from_bytes(raw[q : q + 4], "big"), q + 4
        if flags & 4:
            out["toc"] = list(raw[q : q + 100])
        return out
    if raw[at + 36 : at + 40] == b"VBRI":
        size, frames, entries, scale, wide, each = struct.unpack(">IIHHHH", raw[at + 46 : at + 62].ljust(16, b"\0"))
        places = [scale * int.from_bytes(raw[q : q + wide], "big") for q in range(at + 62, min(at + 62 + entries * wide, len(raw)), max(1, wide))]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "frames_an_entry": each, "toc": places}
    return None


def parse(raw: bytes) -> Stream:
    """Reads a stream, also one that is cut, damaged or preceded by other bytes; bytes without any frame have no headers."""
    s, at, end = Stream(), 0, len(raw)
    if end >= 128 and raw[end - 128 : end - 125] == b"TAG":
        s.v1 = {k: raw[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin-1").strip() for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97))}
        end -= 128
    checks: dict[int, list[int]] = {}
    steady = False
    while at < end:
        if raw[at] == 0x49 and (tag := _id3v2(raw, at)):
            s.tags.update(tag[1])
            at, steady = tag[0], False
            continue
        h = parse_header(raw, at)
        after = at + h.size if h else 0
        if h and after <= end and (steady or after >= end or parse_header(raw, after) or raw[after : after + 3] == b"ID3"):
            steady = True
            if not s.headers and s.vbr is None and (table := _vbr(raw, at, h)):
                s.vbr = table
            else:
                s.headers.append(h)
                s.offsets.append(at)
                if h.protected and h.layer == 3:
                    checks.setdefault(h.side, []).append(at)
            at = after
            continue
        found = raw.find(b"\xff", at + 1, end)  # resynchronise: the next byte that can begin a header
        found = end if found < 0 else found
        s.skipped += found - at
        at, steady = found, False
    view = np.frombuffer(raw, np.uint8)
    for side, places in checks.items():
        p = np.array(places)[:, None]
        good = crc16(view[p + np.array([2, 3, *range(6, 6 + side)])]) == view[p[:, 0] + 4].astype(np.uint32) * 256 + view[p[:, 0] + 5]
        s.crc_ok += int(good.sum())
        s.crc_bad += int((~good).sum())
    return s


def payload_of(raw: bytes, s: Stream | None = None) -> bytes:
    """The main data of the frames, as long as the tag says; a tag that is no number, as foreign ones may be, says nothing."""
    s = s or parse(raw)
    parts = [raw[at + 4 + 2 * h.protected + h.side : at + h.size] for at, h in zip(s.offsets, s.headers)]
    data, said = b"".join(parts), s.tags.get("payload_bytes", "")
    return data[: int(said)] if said.isascii() and said.isdigit() else data


def seek_table(s: Stream, every: int = 1) -> list[int]:
    """The offset of each `every`th frame, so a player reaches any time with a read of few frames."""
    return s.offsets[::every]


def padded(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def media_column(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: a stream for each text (null: empty), whose payload is its UTF-8 with zeros to a multiple of 64."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            raw = [t or b"" for t in texts]
            yield common.arrow_rows(schema, zip(b.column(0).to_pylist(), map(len, raw), [encode(padded(t)) for t in raw]))

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration double, frames long, crc_bad long, skipped long, seek array<long>"


def features(media: DataFrame, every: int = 1) -> DataFrame:
    """FEATURES of a table with doc_id, n_bytes and media. Rows whose media is null or holds no frame have 0 frames and an empty payload."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration", pa.float64()), ("frames", pa.int64()), ("crc_bad", pa.int64()), ("skipped", pa.int64()), ("seek", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            rows = []
            for doc, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = raw or b""
                s = parse(raw)
                data, d = payload_of(raw, s), s.duration
                feature = f"mpeg:{len(s.headers)} frames;{d.numerator}/{d.denominator} s;{s.crc_ok} checked;{(s.vbr or {}).get('kind', '-')}"
                rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, float(d), len(s.headers), s.crc_bad, s.skipped, seek_table(s, every)))
            yield common.arrow_rows(schema, rows)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
