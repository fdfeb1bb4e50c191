"""Word shingle sets of whole texts, computed on Arrow string buffers.

A text is lower-cased (A-Z only), its words are the maximal runs of
``[^\\x20\\x09-\\x0D]``, and its set holds the distinct 5-word shingles; a text
of 1-4 words has its whole sequence as the one shingle, a text without words
(or null) has the empty set. A shingle is represented by a 64-bit hash.

All bytes of a batch are hashed at once: UTF-8 never uses the separator or
A-Z bytes inside a multi-byte character, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_R = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _R)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1 << 16), _R, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS[:n]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]] if n else \
        np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if n else 0)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and, per row, the index of its first word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    word = ~_IS_SEP[low]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts - 1] = False
    end = np.flatnonzero(word & ~after)
    # position inside the word = index - start of its word
    code = _BYTE_CODE[low]
    length = end - start + 1
    idx = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), dtype=np.int64)
    first[start] = start
    np.maximum.accumulate(first, out=first)
    code *= _powers(int(length.max(initial=1)))[np.where(word, idx - first, 0)]
    code[~word] = 0
    sums = np.add.reduceat(code, start) if len(start) else np.zeros(0, np.uint64)
    return mix64(sums + length.astype(np.uint64)), np.searchsorted(start, offsets, side="left")


def shingle_sets(texts: pa.Array, chunk_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, in row order.

    Rows are worked on in runs of about ``chunk_bytes`` bytes; one longer text
    is a run of its own."""
    data, offsets = _buffers(texts)
    n, row = len(texts), 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        part = offsets[row:stop + 1] - offsets[row]
        words, firsts = word_hashes(data[offsets[row]:offsets[stop]], part)
        if len(words) >= WORDS:
            m = len(words) - WORDS + 1
            acc = np.zeros(m, dtype=np.uint64)
            for k in range(WORDS):
                acc = (acc + words[k:k + m]) * _R
            acc = mix64(acc)
        else:
            acc = np.zeros(0, np.uint64)
        for i in range(stop - row):
            a, b = int(firsts[i]), int(firsts[i + 1])
            if b - a >= WORDS:
                s = np.sort(acc[a:b - WORDS + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
                yield row + i, s
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    h = mix64((h + words[k:k + 1]) * _R)
                yield row + i, h
            else:
                yield row + i, np.zeros(0, np.uint64)
        row = stop


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set, equal for equal sets (signed, as Spark's bigint)."""
    if not len(s):
        return 0
    x = mix64(s ^ _R).sum(dtype=np.uint64, keepdims=True)
    y = mix64(s + _MIX1).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(x + y * _R + np.uint64(len(s))).view(np.int64)[0])
