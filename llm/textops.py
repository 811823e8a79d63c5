"""Vectorised helpers on batches of texts, used inside Arrow tasks.

A batch of texts is one byte array and the offsets of its texts.  A word is a maximal run of bytes
other than the six white-space bytes ``\\x20 \\x09-\\x0D``; a null text has no words.  Words get 64-bit
polynomial hashes, mixed at the end; equal words always have equal hashes, different ones collide
with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# texts of about this many bytes are worked on at once; a longer text is a piece of its own
PIECE = 1 << 20
# words of about this many bytes are hashed at once; the arrays for it and tables of powers take 64 bytes for each
STRETCH = 1 << 18
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.copy()
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(_STEP))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to ``n``; tables up to 2 million stay in the worker."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = (out[0], out[1])
        if n <= 2 * PIECE:
            _tables[base] = have
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, without a loop over positions."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive word hashes at each index in ``first``."""
    return range_hashes(mix(hashes ^ U(_STEP)), first, first + width, _STEP)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Words:
    """The words of a batch: byte positions, hashes, and ``at[i]:at[i + 1]`` as the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, solid: np.ndarray | None = None):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~WHITE[data] if solid is None else solid[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """One hash a word; very long batches are hashed in stretches, so memory stays a small multiple of the text."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + STRETCH)))
            lo, hi = self.starts[i], self.ends[j - 1]
            out[i:j] = range_hashes(BYTES[self.data[lo:hi]], self.starts[i:j] - lo, self.ends[i:j] - lo, _BASE)
            i = j
        return out

    def window_starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window of ``width`` words that lies within one text, and the text's index."""
        n = np.maximum(self.counts - width + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        skip = np.cumsum(n) - n
        return np.arange(n.sum()) - skip[text] + self.at[:-1][text], text


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur at least twice."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[spot] == keys


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.null_count:
        column = column.cast(kind).fill_null(b"")
    elif column.type != kind:
        column = column.cast(kind)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)
