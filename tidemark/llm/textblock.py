"""Arrow text columns as byte arrays, and word hashing over them in numpy.

Texts are UTF-8; a null text is an empty one. Words are runs of bytes outside
0x09-0x0D and 0x20; A-Z count as a-z. No Python string is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
#: A random number for each byte; upper-case letters have their lower-case ones', white space 0.
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same, with upper-case letters of their own.
EXACT_CODE = BYTE_CODE.copy()
BYTE_CODE[65:91] = BYTE_CODE[97:123]
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
#: Bytes that are handled together; temporary arrays are a few times eight bytes for each.
SLICE_BYTES = 2 << 20


#: What operators keep in a worker between tasks, by name, and how it is dropped.
KEPT: dict[str, Callable[[], None]] = {}


def release(but: str | None = None) -> None:
    """Gives memory that a worker no longer uses back to the machine: workers outlive the stages they served.

    What other operators than `but` keep there is dropped, too."""
    for name, drop in KEPT.items():
        if name != but:
            drop()
    gc.collect()
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts in them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = array.type in (pa.large_string(), pa.large_binary())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Texts that are handled together at most; a text's number in a slice has 13 bits.
SLICE_TEXTS = 8000


def slices(offs: np.ndarray, most: int = SLICE_BYTES, texts: int = SLICE_TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, min(int(np.searchsorted(offs, offs[at] + most, "right")) - 1, at + texts, n))
        yield at, to
        at = to


def runs(*sorted_by: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each stretch of equal rows of columns; none for no rows."""
    n = len(sorted_by[0])
    if not n:
        return []
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sorted_by], axis=0)
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], n], strict=True))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 21, 1 << max(0, n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads each bit over all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words(data: np.ndarray, offs: np.ndarray, code: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, index of its text) of each word, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offs[(offs >= 0) & (offs <= n)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code[data] * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(offs, s, "right") - 1


#: Bits of a shingle's number; the bits above hold its text's number in a slice.
SHINGLE_BITS = 51
_STEP = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64)) for k in range(8)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, texts) of the distinct word shingles, ascending within each text.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    h, _, _, of = words(data, offs)
    n = len(offs) - 1
    count = np.bincount(of, minlength=n)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    runs = np.arange(max(0, len(h) - size + 1))
    runs = runs[of[runs] == of[runs + size - 1]] if len(runs) else runs
    total = np.zeros(len(runs), np.uint64)
    for k in range(size):
        total += h[runs + k] * _STEP[k]
    texts = of[runs]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(size - 1):
            has = count[short] > k
            whole[has] += h[first[short[has]] + k] * _STEP[k]
        total, texts = np.concatenate([total, whole]), np.concatenate([texts, short])
    key = np.sort((texts.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (mix(total) >> np.uint64(64 - SHINGLE_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & np.uint64((1 << SHINGLE_BITS) - 1)).astype(np.int64), (key >> np.uint64(SHINGLE_BITS)).astype(np.int64)
