"""Words of UTF-8 texts found and hashed in numpy, straight on Arrow's buffers.

A word is a run of bytes outside a separator class; with separators below 0x80 this is the
same as the class over characters.  A word's 64-bit hash is a sum of random values of its
bytes times powers of an odd base (by prefix sums over the whole block), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                        # A-Z hash as a-z
_BYTE_CASED = _BYTE.copy()
_BYTE_CASED[65:91] = _rng.integers(0, 1 << 63, 26, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POWERS = {}

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of one block of texts that is worked on at once.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("n", 0)
    if have < n:
        size = max(n, BLOCK)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cut the documents into runs [i, j) of at most ``most`` bytes (a longer text is its own run)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of one block of documents.

    ``starts``/``ends``: byte places in ``data``; ``hashes``: 64-bit, one per word;
    ``bounds[d]:bounds[d + 1]``: the words of document d.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int,
                 separators: np.ndarray = SPACE, fold_case: bool = True):
        lo, hi = int(offsets[i]), int(offsets[j])
        self.data = b = raw[lo:hi]
        self.docs = offs = offsets[i:j + 1] - lo
        inside = ~separators[b]
        n = len(b)
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = offs[(offs > 0) & (offs < n)]
            before[cuts] = False
            after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTE if fold_case else _BYTE_CASED)[b] * up[:n], out=sums[1:])
        length = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts]
                          + length * np.uint64(0x2545F4914F6CDD1D))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (the last k - 1 of a block are not meant)."""
        h = self.hashes
        n = max(0, len(h) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for x in range(k):
            out += h[x:x + n] * _ODD[x]
        return mix(out)


_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a word sequence shorter than a window."""
    terms = np.append(hashes * _ODD[:len(hashes)], _ODD[63:] * np.uint64(len(hashes)))
    return mix(terms.sum(dtype=np.uint64, keepdims=True))[0]
