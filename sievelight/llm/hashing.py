"""Vectorised hashing of words and spans, shared by the operators that run in Python workers.

Words are ``[^\\x20\\x09-\\x0D]+``: their separators are ASCII, so everything
works on UTF-8 bytes.  A span's hash is a polynomial over its bytes modulo 2**64
(from prefix sums, so any span costs the same), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = U(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0xD1342543DE82EF95))


def powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[start:end]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(TABLE[buf] * powers(U(_BASE), len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(buf) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


class Words:
    """Words of several texts laid end to end."""

    def __init__(self, texts: list[bytes], lower: bool):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        # a line feed after each text keeps words apart and is none itself
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.first = np.cumsum(lens + 1) - lens - 1
        if lower:
            self.buf = lower_ascii(self.buf)
        gap = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1))
        self.gap, self.starts, self.ends = gap, edge[0::2], edge[1::2]
        #: index of each text's first word, and one more for the end
        self.offsets = np.append(np.searchsorted(self.starts, self.first), len(self.starts))
        self.counts = np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, at the index of its first; runs may cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * U(0x9FB21C651E98DF25) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


#: Rows whose texts are turned into Python objects at once.
ROWS = 128


def batches(stream: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``most`` bytes of the text column (the last one), with the texts as UTF-8; null is empty."""
    for batch in stream:
        col = batch.column(batch.num_columns - 1)
        at, size, texts = 0, 0, []
        for start in range(0, batch.num_rows, ROWS):
            for i, t in enumerate(col.slice(start, ROWS).cast(pa.binary()).to_pylist(), start):
                t = t or b""
                if size and size + len(t) > most:
                    yield batch.slice(at, i - at), texts
                    at, size, texts = i, 0, []
                texts.append(t)
                size += len(t)
        if texts:
            yield batch.slice(at), texts
