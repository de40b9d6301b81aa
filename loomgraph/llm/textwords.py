"""Vectorised word splitting and hashing over blocks of texts.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A block is a list
of UTF-8 byte strings; every function works on whole blocks with numpy, so the
cost is a few passes over the bytes instead of a Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = np.random.RandomState(20_240_501)
_BYTE = _RANDOM.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


_BASE = 0xA24BAED4963EE407
_POWERS = [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)]
#: Bytes whose running sums are made at once.
_PIECE = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(text: str | None) -> bytes:
    """The bytes of a text; lone surrogates survive, null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def blocks(texts: Iterable[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``most`` bytes together, with the first one's position."""
    held: list[bytes] = []
    first = size = 0
    for k, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, held
            held, first, size = [], k, 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


class Words:
    """Words of a block: byte ``starts`` and ``ends`` in ``buf``; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[self.buf]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, at)
        self.offsets = at

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes and their places in the word."""
        return range_hashes(self.buf, self.starts, self.ends)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.full(n, x, dtype=np.uint64)
            _POWERS[k][0] = 1
            np.multiply.accumulate(_POWERS[k], out=_POWERS[k])
    return _POWERS[0][:n], _POWERS[1][:n]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (none empty, in order) that depend on their bytes alone: mixed polynomials, from running sums over pieces of the buffer."""
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(buf) + _PIECE, _PIECE)) if len(starts) else ()
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        first = starts[a]
        s, e = starts[a:b] - first, ends[a:b] - first
        n = int(e.max())
        powers, back = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[first : first + n]] * powers, out=sums[1:])
        out[a:b] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * _M2)
    return out


def grams(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the ``len(words) - k + 1`` runs of k consecutive word hashes (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 8:
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            shift = np.uint64((salt + j + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)
            out = mix(out + words[j : j + n] + shift) if j else words[:n] + shift
        return mix(out)
    base = np.uint64((0xD1342543DE82EF95 + 2 * salt) & 0xFFFFFFFFFFFFFFFF)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.ones(len(words) + 1, dtype=np.uint64)
    powers[1:] = base
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words + np.uint64(salt * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)) * powers[:-1], out=sums[1:])
    inverse = np.ones(n, dtype=np.uint64)
    inverse[1:] = back
    np.multiply.accumulate(inverse, out=inverse)
    return mix((sums[k:] - sums[:n]) * inverse)
