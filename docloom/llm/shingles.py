"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docloom.llm.textbytes import buffers, mix, words

#: Odd numbers by which a shingle's words are told apart by their places.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, k: int, sizes: bool = False) -> list[np.ndarray] | list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct k-word shingles, or its whole sequence if shorter; words are those between ASCII blanks, A-Z as a-z. sizes: with the bytes of each shingle's words."""
    raw, at = buffers(texts)
    doc, (h,), size = words(raw, at)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = max(0, len(h) - k + 1)
    every = np.zeros(n, np.uint64)
    for i in range(k):
        every += h[i : i + n] * _PLACES[i]
    every = mix(every)
    long = np.zeros(n, np.int32)
    for i in range(k if sizes else 0):
        long += size[i : i + n]
    out, lengths = [], []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j - i >= k:
            s = every[i : j - k + 1]
            order = np.argsort(s) if sizes else None
            s = s[order] if sizes else np.sort(s)
            first = np.concatenate([[True], s[1:] != s[:-1]])
            out.append(s[first])
            if sizes:
                lengths.append(long[i : j - k + 1][order][first])
        elif j > i:
            # Its length sets it apart from a shingle of k words.
            whole = (h[i:j] * _PLACES[: j - i]).sum(dtype=np.uint64) + np.uint64(j - i)
            out.append(mix(np.array([whole], np.uint64)))
            lengths.append(np.array([size[i:j].sum()], np.int32))
        else:
            out.append(np.zeros(0, np.uint64))
            lengths.append(np.zeros(0, np.int32))
    return list(zip(out, lengths, strict=True)) if sizes else out
