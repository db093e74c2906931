"""Cached encoding equals the tokenizers library on whole texts; packing and token files keep every id."""

import io
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltwarden.llm import packing, tokenfile
from voltwarden.llm.encoding import encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXT = st.lists(st.sampled_from(list("aB é'sß.,!#12 \n\t") + ["  ", " ", "\x1c", "Σ", "é", "日", "don't", " the", "😀", "\x1e", "\x1f", "\u2028", "\xa0", "İ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]), max_size=60).map("".join)


def plain(name, text):
    return _plain[name].encode(text, add_special_tokens=False).ids


_plain = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.none() | TEXT, max_size=6))
def test_same_ids(name, texts):
    """Those of the plain library call, for a whole batch, also with strings of added tokens."""
    for end in (None, 7):
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder(public_tokenizers.path(name), end).batch(texts).to_pylist()]
        assert got == [plain(name, t or "") + ([] if end is None else [end]) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_same_ids_with_few_pieces_held(name, monkeypatch):
    """Pieces that were dropped from a full table are encoded anew."""
    from voltwarden.llm import encoding

    monkeypatch.setattr(encoding, "PIECES", 40)
    monkeypatch.setattr(encoding, "RUNS", 10)
    rng, own = random.Random(3), encoding.Encoder(public_tokenizers.path(name), 1)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcdeé") * rng.randint(1, 9) + rng.choice(["", ",", "!", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        assert [np.frombuffer(x, "<u2").tolist() for x in own.batch(texts).to_pylist()] == [[*plain(name, t), 1] for t in texts]


def test_very_long_text():
    text = "The quick, brown foxés jump. " * 60_000
    for name in NAMES:
        (got,) = encoder(public_tokenizers.path(name)).batch([text]).to_pylist()
        assert np.frombuffer(got, "<u2").tolist() == plain(name, text)


def test_special_strings_have_their_ids():
    assert 50256 in np.frombuffer(encoder(public_tokenizers.path(NAMES[0])).batch(["a <|endoftext|> b"])[0].as_py(), "<u2")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=12))
def test_plan_places_everything(counts):
    rows = packing.plan(counts, 40)
    bins = {}
    for length, lo, hi, first, per, at in rows:
        for r in range(hi - lo):
            bins.setdefault(first + r // per, []).append((at + r % per * length, length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 40
    for length, n in counts.items():
        assert sum(hi - lo for x, lo, hi, *_ in rows if x == length) == n


def test_fullest_is_a_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(0, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums}
        got = packing.fullest(room, dict(counts))
        assert all(counts[x] >= n for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def rows_of(spark):
    texts = [None, "", "a <|endoftext|>", "word " * 300, "x", "x", "The quick brown fox.\n\nJumps  over", "ß é 😀 " * 40]
    return spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(texts)] + [(1, "again", None, 0), (None, "no id", None, 0)], "doc_id long, text string, ids string, length int")


def test_packing(spark):
    path = public_tokenizers.path(NAMES[0])
    df = rows_of(spark)
    got = packing.pack_documents(df, path, capacity=64, keep_ids=True).toPandas()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(plain(NAMES[0], r.text or "")) + 1) for r in df.collect())
    sizes = got.fillna({"doc_id": -1}).groupby("doc_id").length.sum()
    assert sizes.to_dict() == {d: sum(n for x, n in want if x == d) for d, _ in want}
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() == -(-got.length.sum() // 64)
    long = got[got.doc_id == 3].sort_values("piece")
    assert (long.length.iloc[1:] == 64).all() and long.start.tolist() == [0, *long.length.cumsum().tolist()[:-1]]
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in long.ids])
    assert ids.tolist() == [*plain(NAMES[0], "word " * 300), 0]
    whole = packing.sequences(packing.pack_documents(df, path, capacity=64, keep_ids=True)).toPandas()
    assert (whole.ids.map(len) == 4 * whole.tokens).all()
    assert packing.pack_documents(df.limit(0), path).count() == 0


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_file_round_trip(unit):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    docs = [(i if i % 5 else None, rng.integers(0, 49408, rng.integers(0, 900), dtype=np.uint32).tobytes()) for i in range(50)]
    out = io.BytesIO()
    assert tokenfile.write_file(out, docs, 16, unit, block=256) == (50, sum(len(x) for _, x in docs) // 4)
    reader = tokenfile.Reader(pa.BufferReader(out.getvalue()))
    assert list(reader.documents()) == docs
    flat = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    for at, n in ((0, 1), (255, 2), (1000, 777), (len(flat) - 3, 3), (5, 0)):
        assert reader.ids(at, n).tolist() == flat[at : at + n].tolist()


def test_token_files(spark):
    df = rows_of(spark)
    manifest = tokenfile.token_files(df, public_tokenizers.path(NAMES[1]), 1)
    got = tokenfile.read_files(manifest).toPandas()
    start = 0
    want = []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*plain(NAMES[1], r.text or ""), 1], "<u4")
        want.append((-1 if r.doc_id is None else r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = got.fillna({"doc_id": -1}).sort_values("start")
    keep = [x for x in want if x[0] != 1]
    assert [tuple(map(int, x)) for x in got.itertuples(index=False) if x[0] != 1] == keep
    empty = tokenfile.token_files(df.limit(0), public_tokenizers.path(NAMES[1]), 1)
    assert empty.count() == 0 and tokenfile.read_files(empty).count() == 0


def test_ids_must_fit(spark):
    with pytest.raises(ValueError):
        tokenfile.narrow(np.array([70000], "<u4").tobytes(), 16)
