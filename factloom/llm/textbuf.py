"""Vectorised word work on Arrow string columns.

The functions read the UTF-8 bytes of a whole batch in place, so no Python
string is made for a word. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Python workers live on between tasks; the system's pool gives freed memory back, so that idle workers stay small.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that are worked on at once; one longer text is its own chunk.
CHUNK_BYTES = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW_LEN = 1 << 12
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_POW_LEN, _B, np.uint64), dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words, given the bytes that end them."""
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


#: Words are runs of anything but ASCII white space.
NON_SPACE = byte_class(b" \t\n\x0b\x0c\r")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of whole texts with at most ``limit`` bytes, or of one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one kind: their 64-bit hashes, kinds, and first run of each text.

    ``kinds`` has the kind of each byte; kind 0 separates. Runs end with texts.
    """
    n = len(data)
    firsts = np.zeros(len(off), np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), firsts
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
    new[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(new)
    lens = np.diff(starts, append=n)
    keep = kinds[starts] != 0
    at = np.arange(n, dtype=np.int64) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        vals = (data.astype(np.uint64) + np.uint64(1)) * _POW[at & (_POW_LEN - 1)]
        if lens.max() > _POW_LEN:  # the place in a very long run counts as well
            vals *= mix64((at // _POW_LEN).astype(np.uint64)) | np.uint64(1)
        hashes = mix64(np.add.reduceat(vals, starts) + lens.astype(np.uint64))
    starts, hashes = starts[keep], hashes[keep]
    firsts[:] = np.searchsorted(starts, off)
    return hashes, kinds[starts], firsts


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = NON_SPACE, lower: bool = True):
    """Hashes of the words of each text, and the first word of each text."""
    if lower:
        data = LOWER[data]
    h, _, firsts = run_hashes(data, off, is_word[data].astype(np.uint8))
    return h, firsts


_STEP = [np.uint64(2 * k * 0xD1342543DE82EF95 + 1 & (1 << 64) - 1) for k in range(1, 65)]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words (over text ends too)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out += mix64(h[k : k + m] * _STEP[k])
    return mix64(out)


def shingles(h: np.ndarray, firsts: np.ndarray, n: int):
    """For each text: the hashes of its n-word shingles, in order.

    A text of fewer words, but not none, has its whole sequence as the one.
    """
    grams = ngram_hashes(h, n)
    for i in range(len(firsts) - 1):
        a, b = int(firsts[i]), int(firsts[i + 1])
        if b - a >= n:
            yield grams[a : b - n + 1]
        elif b > a:
            yield ngram_hashes(h[a:b], b - a) + np.uint64(b - a)
        else:
            yield h[:0]
