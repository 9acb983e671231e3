"""Words and hashes of whole texts, in numpy over the bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``; letters A-Z are lower-cased, nothing else is changed.
Hashes are 64-bit: a polynomial over random values for the bytes, mixed at the end. They depend
only on the bytes of the words, so they agree between processes and machines.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

#: Longer words are replaced by their digest before hashing, which bounds the memory of a block.
LONG_WORD = 1 << 16
#: Bytes hashed at a time.
BLOCK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def normalise(text: bytes | None) -> bytes:
    """The lower-cased words of a text, one space between them."""
    if not text:
        return b""
    words = text.lower().split()
    if len(text) > LONG_WORD and max(map(len, words), default=0) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words]
    return b" ".join(words)


def bounds(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a normalised text starts and ends."""
    if not norm:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = np.empty(len(gaps) + 1, np.int64), np.empty(len(gaps) + 1, np.int64)
    starts[0], ends[-1] = 0, len(norm)
    starts[1:], ends[:-1] = gaps + 1, gaps
    return starts, ends


def spans(norm: bytes, k: int = 1, at: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of all runs of k words, in order; fewer words give none."""
    starts, ends = at or bounds(norm)
    n = len(starts) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if len(norm) <= BLOCK:
        return _hashed(norm, starts[:n], ends[k - 1 :])
    out, lo = np.empty(n, np.uint64), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends[k - 1 :], starts[lo] + BLOCK)))
        a, z = starts[lo], ends[hi - 1 + k - 1]
        out[lo:hi] = _hashed(norm[a:z], starts[lo:hi] - a, ends[lo + k - 1 : hi + k - 1] - a)
        lo = hi
    return out


def _hashed(part: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(part) + 1)
    total = np.empty(len(part) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[np.frombuffer(part, np.uint8)] * up[: len(part)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(norm: bytes, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; a shorter text is one shingle, an empty one none."""
    at = bounds(norm)
    return np.unique(spans(norm, min(k, max(1, len(at[0]))), at))


def settle() -> None:
    """Give memory that a finished task freed back to the system: workers wait for their next task while others run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def settled(run):
    """A function of batches that settles when they are done."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            settle()

    return wrapped
