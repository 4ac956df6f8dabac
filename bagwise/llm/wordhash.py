"""64-bit hashes of words and word windows over Arrow text columns.

Whole columns are hashed with array arithmetic: each byte gets a random
64-bit number, a word is the polynomial of its bytes modulo 2^64, read off
running sums, and the result is mixed.  Windows of words are polynomials of
word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_601)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text hashed at a time (a longer text is hashed alone).
AT_ONCE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and their inverses modulo 2^64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n, AT_ONCE) + 1
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        made = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if n <= AT_ONCE:
            _POWERS[int(base)] = have
    return have


def polynomials(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of values[start:end], wherever it stands."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most AT_ONCE bytes, or of one row."""
    sizes = np.diff(offsets(texts))
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > AT_ONCE:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def hash_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, bounds): row i's words are hashes[bounds[i]:bounds[i+1]].
    ``texts``: a string array without nulls."""
    at = offsets(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]]
    if lower:
        raw = LOWER[raw]
    at = at - at[0]
    inside = ~SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[True], ~inside[:-1]]) | edge[:-1]
    after = np.concatenate([~inside[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    words = mix(polynomials(BYTE_VALUES[raw], BYTE_BASE, starts, ends))
    return words, np.searchsorted(starts, at)


def windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of the windows of ``size`` words, one for each start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(n)
    base = np.uint64(int(WORD_BASE) + 8 * seed)
    return mix(polynomials(words, base, starts, starts + size) + np.uint64(seed))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct ``size``-word shingles of one text, sorted; with fewer
    words the whole text as one; none without words."""
    if 0 < len(words) < size:
        whole = polynomials(words, WORD_BASE, np.array([0]), np.array([len(words)]))
        return mix(whole + np.uint64(len(words) * int(BYTE_BASE) % (1 << 64)))
    return np.unique(windows(words, size))
