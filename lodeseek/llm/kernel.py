"""Vectorised text kernels over Arrow batches.

A batch of texts is one flat byte buffer with offsets. All separators of the
contracts are ASCII, so words are found on UTF-8 bytes without decoding, and
word hashes come from one prefix sum over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 64, 256, dtype=U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 19)
        a, b = np.full(size, _BASE, U64), np.full(size, _INV, U64)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a), np.cumprod(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def blocks(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, end row, bytes, offsets."""
    buf, offs = flat(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, within: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes ``within``, and the index of each text's first run (one more entry than texts)."""
    w = within[buf]
    at = offs[:-1][offs[:-1] < offs[1:]]
    prev, nxt = np.empty_like(w), np.empty_like(w)
    if len(w):
        prev[1:], nxt[:-1] = w[:-1], w[1:]
        prev[at], nxt[-1] = False, False
        nxt[at[1:] - 1] = False
    starts, ends = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Spans:
    """64-bit hashes of any byte spans of a buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        p, self.q = _powers(len(buf) + 1)
        self.h = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * p[: len(buf)], out=self.h[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.h[ends] - self.h[starts]) * self.q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(buf)(starts, ends)


def hash_of(s: bytes) -> int:
    b = np.frombuffer(s, np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def shingles(words: np.ndarray, first: np.ndarray, size: int = 3) -> list[np.ndarray]:
    """For each text, the hashes of its distinct shingles of ``size`` words, ascending; with fewer words the whole
    sequence is one shingle, without words there is none."""
    a = np.zeros(0, U64)
    if len(words) >= size:
        a = words[: len(words) - size + 1] * U64(3)
        for k in range(1, size):
            a = mix(a + words[k : len(words) - size + 1 + k] * U64(2 * k + 3))
    out = []
    for f, k in zip(first[:-1].tolist(), np.diff(first).tolist(), strict=True):
        if k >= size:
            out.append(np.unique(a[f : f + k - size + 1]))
        elif k:
            x = words[f : f + 1] * U64(0x51)
            for j in range(f + 1, f + k):
                x = mix(x + words[j : j + 1] * U64(0x53))
            out.append(mix(x + U64(k)))
        else:
            out.append(words[f:f])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
