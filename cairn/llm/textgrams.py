"""Hashes of the words, word windows and characters of a batch of texts, in numpy, without a Python loop over texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U64)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
#: An odd base, 3 modulo 4, so that 1 - base has a single factor of two; and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C13
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 << 20:
            _powers[base] = have
    return have[:n]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_hashes(texts: pa.Array, lower: bool = False, gaps: np.ndarray = _IS_GAP) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words begin (one more entry than texts).

    Words are separated by the bytes marked in `gaps`: space, \\t, \\n, \\v, \\f and \\r; lower: A to Z count as a to z.
    """
    data, at = bytes_of(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    gap = gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * _power(_BACK, n)[starts]
    return mix(hashes + (ends - starts).astype(U64)), np.searchsorted(starts, at)


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of each eight bytes in a row, and where each text's begin; a text of fewer bytes is one piece.

    data, at: the bytes of all texts and where each begins, as from `bytes_of`. No text may be empty.
    """
    size = np.diff(at)
    found = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).copy()
    short = np.flatnonzero(size < 8)
    found[at[:-1][short]] &= (U64(1) << (8 * size[short]).astype(U64)) - U64(1)
    found ^= found >> U64(29)
    found *= U64(_BASE)
    begins = np.ones(len(data), bool)
    over = at[1:, None] - np.arange(1, 8)
    begins[over[over > at[:-1, None]]] = False
    return (found >> U64(32)).astype(np.uint32)[begins], np.concatenate([[0], np.cumsum(np.maximum(size - 7, 1))])


def windows(hashes: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of n words and the text it is in; a text of 1 to n - 1 words is one window."""
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts)
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    last = at[1:][text]
    place = np.arange(len(hashes))
    out = np.zeros(len(hashes), U64)
    for j in range(n):
        inside = place + j < last
        out += np.where(inside, (padded[j : j + len(hashes)] | U64(1)) * _STEP[j], U64(0))
    whole = (place + n <= last) | ((place == at[:-1][text]) & (counts[text] < n))
    return mix(out[whole]), text[whole]


def distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, cut to 52 bits, in order, and where each text's begin. At most 4096 texts."""
    if texts > 4096:
        raise ValueError("more than 4096 texts")
    keys = np.sort((text.astype(U64) << U64(52)) | (hashes >> U64(12)))
    if len(keys):
        keep = np.empty(len(keys), bool)
        keep[0] = True
        np.not_equal(keys[1:], keys[:-1], out=keep[1:])
        keys = keys[keep]
    at = np.searchsorted(keys, np.arange(texts, dtype=U64) << U64(52))
    return keys & U64((1 << 52) - 1), np.append(at, len(keys))


def byte_totals(data: np.ndarray) -> np.ndarray:
    """Running totals of the data's bytes, of which `byte_window_hashes` and `byte_hashes` are made."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    return total


def byte_window_hashes(total: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n bytes in a row of the data, whatever text they are in."""
    count = max(0, len(total) - n)
    return mix((total[n:] - total[:count]) * _power(_BACK, len(total))[:count])


def byte_hashes(total: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The same of the n bytes that begin at some places."""
    return mix((total[begin + n] - total[begin]) * _power(_BACK, len(total))[begin])
