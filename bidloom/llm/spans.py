"""Hashes of byte spans and words for whole Arrow batches at once.

A batch of texts is one flat byte array. A polynomial prefix sum over it gives
the hash of any span with two look-ups, so no Python code runs per word. All
arithmetic wraps modulo 2**64; byte values go through a random table first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_random = np.random.default_rng(20240229)
_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._run(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, U64(base))
        out[0] = 1
        return np.multiply.accumulate(out)


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Hasher:
    """Hashes of spans ``[start, end)`` of one flat array of bytes, or of 64-bit hashes taken as they are."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = _powers.get(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data if data.dtype == U64 else _TABLE[data]) * up[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of each span of ``width`` bytes."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``most_bytes`` of text, or one longer row."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the number of words of each row."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = at[1:] > at[:-1]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    per_row = np.diff(np.searchsorted(start, at))
    return start, end, per_row


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a group ends, with the group boundaries.

    The rows must come sorted by ``key`` (64-bit integer columns without nulls).
    A group that spans batches is joined, so a batch grows with its largest group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _edges(batch, key)
        if rest and any(batch.column(k)[0] != rest[-1].column(k)[rest[-1].num_rows - 1] for k in key):
            yield _closed(rest, key)
            rest = []
        if len(edges) > 2:
            cut = int(edges[-2])
            yield _closed([*rest, batch.slice(0, cut)], key)
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield _closed(rest, key)


def _edges(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in key:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _closed(parts: list[pa.RecordBatch], key: list[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    whole = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    return whole, _edges(whole, key)
