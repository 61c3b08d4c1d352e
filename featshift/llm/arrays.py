"""Text columns as flat byte arrays: words, hashes and bounded slices for Arrow tasks.

Arrow keeps a string column as one byte buffer with offsets. The helpers below work on
that buffer with numpy, so no Python object is made per word or per position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and odd multipliers with their inverses modulo 2^64.
BYTE_VALUES = _SEED.integers(1, 2**64, size=(2, 256), dtype=U64)
MULTIPLIERS = _SEED.integers(1, 2**63, size=2, dtype=U64) * U64(2) + U64(1)
_MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Separators: white space 0x20 and 0x09-0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (bijective)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * _MIX[0]
        x = (x ^ (x >> U64(33))) * _MIX[1]
    return x ^ (x >> U64(33))


class Powers:
    """Powers of a multiplier and of its inverse, grown on demand."""

    def __init__(self, which: int):
        self.multiplier = MULTIPLIERS[which]
        self.inverse = U64(pow(int(self.multiplier), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, m, dtype=U64)))) for m in (self.multiplier, self.inverse))


_POWERS = (Powers(0), Powers(1))


class RollingHash:
    """Hashes of any byte ranges of ``data`` after one pass."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.powers = _POWERS[which]
        self.powers.reach(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[which][data] * self.powers.up[: len(data)], out=self.prefix[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.powers.down[starts])

    def windows(self, k: int) -> np.ndarray:
        """Hash of each ``k``-byte string, by start."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.powers.down[:n]) if n > 0 else np.zeros(0, dtype=U64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offset of each row (nulls are empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        _, bounds = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (one more at the end)."""
    inside = ~separators[data]
    first = np.zeros(len(data), dtype=bool)
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_PLACES = np.zeros(0, dtype=U64)


def _places(n: int) -> np.ndarray:
    """A pseudo-random value for each of the first ``n`` places of a word."""
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = mix(np.arange(1, max(n, 1024) + 1, dtype=U64) * _MIX[0])
    return _PLACES


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that do not overlap and are in order.

    Every byte is scrambled together with its place in the span before the sum is taken, so
    that only chance makes the hashes of different strings equal: no power series is involved.
    """
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = BYTE_VALUES[0][data[place + np.repeat(starts, lengths)]] ^ _places(int(lengths.max()))[place]
    with np.errstate(over="ignore"):
        value = (value ^ (value >> U64(29))) * _MIX[1]
        value ^= value >> U64(32)
        return mix(np.add.reduceat(value, first) + lengths.astype(U64) * _MIX[0])


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each white-space word, and the index of each row's first word."""
    starts, ends, firsts = word_spans(data, bounds)
    return span_hashes(data, starts, ends), firsts


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each segment ``values[firsts[i]:firsts[i + 1]]``; empty ones give 0."""
    out = np.zeros(len(firsts) - 1, dtype=values.dtype)
    some = np.flatnonzero(np.diff(firsts))
    if len(some):
        out[some] = np.add.reduceat(values, firsts[some])
    return out
