"""Sets of word shingles as 64-bit hashes, computed over whole batches of texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_R_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = _BYTES[_LOWER]
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, WORDS + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which all bits depend on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            factors = np.full(n, _R, np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = _R_INVERSE
            self.down = np.multiply.accumulate(factors)
        return self.up, self.down


_powers = _Powers()


def words(raw: bytes) -> np.ndarray:
    """The hash of each word of a text in UTF-8: runs of bytes other than ASCII white space, A-Z as a-z."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers.upto(len(b) + 1)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of `size` words.

    A text of fewer words is one shingle; a null text, or one without words, has none.
    """
    h = words(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = min(size, len(h))
    steps = _STEPS if size == WORDS else np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, size + 1)], np.uint64)
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * steps[k]
    s = mix(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def class_id(shingles: np.ndarray) -> int:
    """A 63-bit id of a set, never 0: equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1 or 1


def sets(texts: list[str | None], size: int = WORDS) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingle_set(t, size)
