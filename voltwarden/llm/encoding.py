"""Token ids of whole texts by the tokenizers library, with a cache of the pieces that it cuts texts into.

Byte-pair encoding never merges across the cuts of its pre-tokenizer. Two families of pre-tokenizer are known here to
cut at white space whatever stands around it, so a text can be cut there first and each distinct piece encoded once:

* "led": byte-level with the usual pattern. A single space between two other characters always starts a new piece and
  belongs to the piece after it; a single line feed between two other characters is a piece of its own.
* "apart": the pattern removes white space, so every run of it is a cut.

Both patterns also cut between a run of letters and a run of punctuation without an apostrophe behind it, so a piece of
that form is two pre-tokens, which go to the tokenizer's model directly. A batch of texts is cut by Arrow, which also
finds the distinct pieces, so Python sees each of these once a batch. Any other tokenizer, any text whose white space is
not of that plain form, and any text with a string of the tokenizer's added tokens is encoded as a whole.
"""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces held at once, and pre-tokens in each half of their cache; of these the older half goes when the newer is full.
PIECES, RUNS = 400_000, 150_000
#: Between the pieces of a led text, and the mark of a text's end; texts that hold such a character are encoded whole.
CUT, END = "\x1f", "\x1e"
_ODD = {"led": re.compile("[\x1c-\x1f]"), "apart": re.compile("[\x1c-\x1fΣ]")}
_TAIL = string.punctuation.replace("'", "")


def _visible() -> list[str]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary: printable Latin-1 for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


VISIBLE = _visible()


def shown(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.replace(" ", VISIBLE[32])
    return "".join([VISIBLE[b] for b in text.encode()])


def family(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "led"
    if pre.get("type") == "Sequence":
        first = pre["pretokenizers"][0]
        split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        kinds = {n["type"] for n in (norm or {}).get("normalizers", [])}
        if split and "\\s" in first["pattern"].get("Regex", "") and kinds <= {"NFC", "Replace", "Lowercase"}:
            return "apart"
    return "whole"


class _Runs(dict):
    """pre-token -> its ids as bytes, encoded when first met."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, run: str) -> bytes:
        found = self.old[run] if run in self.old else self.encode(run)
        if len(self) >= RUNS:
            self.old = dict(self)
            self.clear()
        self[run] = found
        return found


class _Pieces:
    """A table of pieces and their ids in Arrow columns: a batch's pieces are looked up in it at once.

    Pieces that it lacks are encoded and added. When it is full, the half that was met least goes.
    """

    def __init__(self, encode, fixed: dict[str, bytes]):
        self.encode = encode
        self.names, self.ids = pa.array(list(fixed), pa.string()), pa.array(list(fixed.values()), pa.binary())
        self.unfit, self.met = np.zeros(len(fixed), bool), np.full(len(fixed), 1 << 62)

    def codes(self, pieces: pa.Array) -> np.ndarray:
        """The row of each piece; all are rows of the table until the next call."""
        if len(self.names) > PIECES:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: PIECES // 2])
            rows = pa.array(keep)
            self.names, self.ids = self.names.take(rows), self.ids.take(rows)
            self.unfit, self.met = self.unfit[keep], np.where(self.met[keep] < 1 << 62, self.met[keep] // 2, 1 << 62)
        found = pc.index_in(pieces, value_set=self.names)
        lacking = found.is_null()
        codes = found.fill_null(-1).to_numpy(zero_copy_only=False)
        if found.null_count:
            rest = pieces.filter(lacking)
            new = rest.unique()
            ids = list(map(self.encode, new.to_numpy(zero_copy_only=False).tolist()))
            codes = codes.copy()
            codes[lacking.to_numpy(zero_copy_only=False)] = len(self.names) + pc.index_in(rest, value_set=new).to_numpy(zero_copy_only=False)
            self.names = pa.concat_arrays([self.names, new])
            self.ids = pa.concat_arrays([self.ids, pa.array([x or b"" for x in ids], pa.binary())])
            self.unfit = np.append(self.unfit, [x is None for x in ids])
            self.met = np.append(self.met, np.zeros(len(ids), np.int64))
        counts = np.bincount(codes, minlength=len(self.met))
        self.met = np.where(self.met < 1 << 62, self.met + counts, self.met)
        return codes


class Encoder:
    """batch(texts): their ids as little-endian unsigned integers of `width` bytes, 2 where the vocabulary allows it.

    Ids are those of the library's encode(text, add_special_tokens=False), so a string of an added token, such as a
    mark of a text's end, gives that token's id; null is an empty text. With an end_id, it stands behind each text's.
    """

    def __init__(self, path: str, end_id: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.family, self.size = family(spec), self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.tokenize, self.runs = self.tokenizer.model.tokenize, _Runs(self.run)
        self.end = b"" if end_id is None else self.packed([end_id])
        self.pieces = _Pieces(self.piece, {END: self.end, "": b""} if self.family == "apart" else {END: self.end})

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def run(self, run: str) -> bytes:
        """The ids of one pre-token."""
        return self.packed([t.id for t in self.tokenize(shown(run))])

    def piece(self, piece: str) -> bytes | None:
        """The ids of what stands between cuts."""
        word = piece.rstrip(_TAIL)
        if self.family == "led":
            if piece == "\n":
                return self.whole(piece)
            body = piece[1:] if piece[:1] == " " else piece
            if not body or body[0].isspace() or body[-1].isspace():
                return None
            plain = word[word[:1] == " " :].isalpha()
        else:
            plain = word.isalpha()
        if not plain:
            return self.whole(piece)
        return self.runs[word] + (self.runs[piece[len(word) :]] if len(word) < len(piece) else b"")

    def cut(self, text: str) -> str | None:
        """The text as the family's splitting takes it, its end marked; None: to be encoded whole."""
        if _ODD[self.family].search(text) or (self.added and self.added.search(text)):
            return None
        if self.family == "apart":
            return f"{text.lower()} {END}" if text.isascii() or unicodedata.is_normalized("NFC", text) else None
        return text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}") + CUT + END if text else END

    def batch(self, texts: list[str | None]) -> pa.Array:
        """A binary array of each text's ids."""
        texts = [t or "" for t in texts]
        if self.family == "whole":
            return pa.array([self.whole(t) + self.end for t in texts], pa.binary())
        given = [self.cut(t) for t in texts]
        alone = {i for i, t in enumerate(given) if t is None}
        column = pa.array([END if t is None else t for t in given], pa.string())
        cuts = pc.ascii_split_whitespace(column) if self.family == "apart" else pc.split_pattern(column, CUT)
        codes = self.pieces.codes(cuts.flatten())
        ids = self.pieces.ids.take(pa.array(codes))
        first = np.frombuffer(cuts.buffers()[1], np.int32)[cuts.offset : cuts.offset + len(texts) + 1]
        first = first - first[0]
        unfit = self.pieces.unfit[codes]
        if unfit.any():
            alone |= set((np.searchsorted(first, np.flatnonzero(unfit), side="right") - 1).tolist())
        places = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :][first]
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), ids.buffers()[2]])
        if not alone:
            return out
        return pa.array([self.whole(texts[i]) + self.end if i in alone else x for i, x in enumerate(out.to_pylist())], pa.binary())


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One encoder a worker process, file and end, kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
