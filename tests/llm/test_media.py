"""MPEG audio: an exact round trip, and reading what is damaged."""

import hashlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from voltwarden.llm import media


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip_of_text(raw):
    payload = media.padded(raw.replace(b"\xff", b"f"))
    stream = media.encode(payload)
    s = media.parse(stream)
    assert media.payload_of(stream, s) == payload
    assert s.crc_bad == 0 and s.skipped == 0 and s.crc_ok == len(s.headers)
    assert s.vbr["frames"] == len(s.headers) and s.duration == Fraction(len(s.headers) * 1152, 32000)
    assert all(media.parse_header(stream, at) for at in media.seek_table(s, 1))


def test_damage():
    stream = media.encode(media.padded(b"some text, " * 900))
    whole = media.parse(stream)
    n = len(whole.headers)
    assert n > 5 and whole.tags["TIT2"] == "payload" and whole.v1["title"] == "payload"
    noisy = media.parse(b"noise\xff\xfb" + stream)
    assert len(noisy.headers) == n and noisy.skipped > 0
    at = whole.offsets[2]
    cut = media.parse(stream[:at] + stream[at + 40 :])
    assert len(cut.headers) == n - 1 and cut.skipped > 0
    flipped = bytearray(stream)
    flipped[whole.offsets[1] + 8] ^= 1
    assert media.parse(bytes(flipped)).crc_bad == 1
    assert media.parse(b"").headers == [] and media.parse(b"no audio at all").headers == []


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 70, "x"), (3, "é" * 70, "x"), (None, "a" * 5000, "x")], "doc_id long, text string, media string")
    rows = media.features(media.media_column(df)).collect()
    assert sorted(r.n_bytes for r in rows) == [0, 0, 140, 140, 5000]
    for r in rows:
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 and r.crc_bad == 0
        if r.n_bytes == 140:
            assert r.payload_sha256 == hashlib.sha256(media.padded(("é" * 70).encode())).hexdigest()
    assert media.features(media.media_column(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 0, b"nothing")], "doc_id long, n_bytes long, media binary")
    assert {r.frames for r in media.features(odd).collect()} == {0}


def test_seek_offsets_of_all_frames(spark):
    df = spark.createDataFrame([(1, "word " * 4000), (2, "")], "doc_id long, text string")
    streams = media.media_column(df)
    raw = {r.doc_id: bytes(r.media) for r in streams.collect()}
    for r in media.features(streams).collect():
        assert len(r.seek) == r.frames and list(r.seek) == media.parse(raw[r.doc_id]).offsets


def test_query_columns(spark):
    """Every column of the query from the stored bytes, for several texts."""
    import zlib

    texts = [None, "", "x", "é" * 33, "word " * 900, "a" * 64, "word " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    streams = media.media_column(df)
    raw = {r.doc_id: bytes(r.media) for r in streams.collect()}
    rows = {r.doc_id: r for r in media.features(streams).collect()}
    for i, t in enumerate(texts):
        payload, r = media.padded((t or "").encode()), rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(raw[i]) and r.media_sha256 == hashlib.sha256(raw[i]).hexdigest()
        assert r.feature == f"mpeg:{r.frames} frames;{Fraction(r.frames * 1152, 32000).numerator}/{Fraction(r.frames * 1152, 32000).denominator} s;{r.frames} checked;Xing"
    same = ("payload_sha256", "media_sha256", "feature", "tail_crc32")
    assert all(rows[4][c] == rows[6][c] and rows[0][c] == rows[1][c] for c in same)


def tag(major, flags, frames):
    size = len(frames)
    return b"ID3" + bytes([major, 0, flags]) + bytes(size >> 7 * k & 127 for k in (3, 2, 1, 0)) + frames


def test_foreign_tags(spark):
    """Tags of other versions and with other contents never raise, and are read where they can be."""
    stream = media.encode(media.padded(b"abc " * 300))
    s = media.parse(stream)
    head = media._id3v2(stream, 0)[0]
    for value in ("abc", "-5", "", "²", "9" * 40):
        text = b"\3payload_bytes\0" + value.encode()
        odd = tag(4, 0, b"TXXX" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text) + stream[head:]
        assert len(media.payload_of(odd)) >= len(media.payload_of(stream, s))
    df = spark.createDataFrame([(1, 0, bytearray(odd))], "doc_id long, n_bytes long, media binary")
    assert media.features(df).first().frames == len(s.headers)
    two = media.parse(tag(2, 0, b"TT2\0\0\5\0name") + stream[head:])
    assert two.tags["TT2"] == "name" and len(two.headers) == len(s.headers)
    body = b"\1\xff\xfen\0a\0"
    unsynchronised = (b"TIT2" + len(body).to_bytes(4, "big") + b"\0\0" + body).replace(b"\xff", b"\xff\0")
    assert media.parse(tag(3, 128, unsynchronised)).tags["TIT2"] == "na"
    frame = b"TIT2\0\0\0\3\0\0\0hi"
    assert media.parse(tag(3, 64, b"\0\0\0\6" + bytes(6) + frame)).tags["TIT2"] == "hi"
    assert media.parse(tag(4, 64, b"\0\0\0\6\1\0" + frame)).tags["TIT2"] == "hi"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 255), st.integers(0, 255), st.binary(max_size=80))
def test_any_tag_is_read_without_raising(major, flags, frames):
    media.payload_of(tag(major, flags, frames) + media.encode(media.padded(b"x")))
