"""Words of a text as 64-bit hashes, and hashes of word windows, vectorised per text.

A word is a run of bytes without ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is what
``bytes.split`` cuts at. Texts are handled whole; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the two window hashes; each is invertible modulo 2**64.
BASES = (0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB53)


class WordHashes(dict):
    """Word to hash. Emptied when full, so its size is bounded; it only saves work."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of a word-hash array, from prefix sums modulo 2**64."""

    def __init__(self, base: int = BASES[0]) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        out = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * self.up[: len(h)], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs ``start[i]:end[i]``."""
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def of(self, h: np.ndarray, size: int) -> np.ndarray:
        if len(h) < size:
            return np.zeros(0, dtype=np.uint64)
        p = self.prefix(h)
        return mix((p[size:] - p[:-size]) * self.down[: len(h) - size + 1])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def rows(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with its texts as bytes (None for null)."""
    for batch in batches:
        yield batch, batch.column(text).cast(pa.binary()).to_pylist()


def in_bounds(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``limit`` bytes of text, or a single longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
