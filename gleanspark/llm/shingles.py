"""Hashed word shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gleanspark.llm.common import BLANKS, UPPER

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[ord(c) for c in UPPER]] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed together.
WINDOW = 1 << 20
_STEP = 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SMALL, _LARGE = _powers(_BASE, _STEP), _powers(pow(_BASE, _STEP, 1 << 64), WINDOW // _STEP + 1)
_SMALL_INV, _LARGE_INV = _powers(_INVERSE, _STEP), _powers(pow(_INVERSE, _STEP, 1 << 64), WINDOW // _STEP + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _window_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[begins:ends] of one window: a polynomial in the bytes, modulo 2^64, then mixed."""
    n = len(data)
    rows = -(-n // _STEP)
    if rows > len(_LARGE):  # a single word longer than the window
        large, large_inv = _powers(pow(_BASE, _STEP, 1 << 64), rows), _powers(pow(_INVERSE, _STEP, 1 << 64), rows)
    else:
        large, large_inv = _LARGE, _LARGE_INV
    powers = (large[:rows, None] * _SMALL[None, :]).ravel()[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    return mix((total[ends] - total[begins]) * large_inv[begins // _STEP] * _SMALL_INV[begins % _STEP])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the number of words of each text; ``starts`` ends with the length."""
    blank = _BLANK[data]
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    inside = starts[:-1][np.diff(starts) > 0]
    first[inside] = word[inside]
    last = word.copy()
    last[:-1] &= blank[1:]
    last[inside[1:] - 1] = word[inside[1:] - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lower = _LOWER[data]
    out, k = [], 0
    while k < len(begins):
        at = begins[k]
        to = max(int(np.searchsorted(ends, at + WINDOW, "right")), k + 1)
        out.append(_window_words(lower[at : ends[to - 1]], begins[k:to] - at, ends[k:to] - at))
        k = to
    counts = np.diff(np.searchsorted(begins, starts))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and their number by text.

    A text of fewer words than ``size`` has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(data, starts)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    at = np.r_[0, np.cumsum(counts)]
    n = len(words)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        sums[: n - k] += words[k:] * weights[k]
    hashes = mix(sums)
    sets, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, c in enumerate(counts.tolist()):
        if c == 0:
            continue
        if c < size:
            short = np.uint64(c)
            own = mix(np.array([(words[at[i] : at[i + 1]] * weights[:c]).sum(dtype=np.uint64) + short], dtype=np.uint64))
        else:
            own = np.sort(hashes[at[i] : at[i + 1] - size + 1])
            own = own[np.r_[True, own[1:] != own[:-1]]]
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), sizes


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls are empty) and where each text begins, with the length at the end."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
