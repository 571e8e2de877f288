"""Words of whole Arrow batches of text as numpy arrays, without a Python loop over words.

A batch's UTF-8 bytes are read in segments cut between words, so that temporary
arrays stay small however long a text is. A word's hash is a polynomial of its bytes
modulo 2**64, taken from prefix sums, so that hashes of its prefixes come as cheaply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
#: Rows of a batch are taken together up to so many bytes of text.
CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII sign but letters and digits.
SIGN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes as numbers, A-Z as a-z.
CODES = _RANDOM[[i + 32 if 65 <= i <= 90 else i for i in range(256)]]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each starts (and the last ends)."""
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text, or one longer text."""
    _, at = buffers(batch.column(column))
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(raw: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Text of each word; its hash followed by those of its first bytes as prefixes say; its bytes."""
    docs, hashes, sizes = [], [[] for _ in range(1 + len(prefixes))], []
    begins = np.zeros(len(raw) + 1, bool)
    begins[at] = True
    i = 0
    while i < len(raw):
        j = min(len(raw), i + SEGMENT)
        while j < len(raw) and not apart[raw[j]] and not begins[j]:
            j += 1
        b, new = raw[i:j], begins[i : j + 1]
        inside = ~apart[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | new[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:-1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start):
            up, down = powers(len(b))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(CODES[b] * up)])
            docs.append(np.searchsorted(at, start + i, "right") - 1)
            sizes.append((stop - start).astype(np.int32))
            for k, out in enumerate(hashes):
                to = stop if k == 0 else np.minimum(stop, start + prefixes[k - 1])
                out.append(mix((sums[to] - sums[start]) * down[start] + (to - start).astype(np.uint64)))
        i = j
    none = [np.zeros(0, np.uint64)]
    whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return whole(docs, np.int64), [np.concatenate(x or none) for x in hashes], whole(sizes, np.int32)
