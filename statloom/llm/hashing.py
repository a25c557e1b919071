"""Vectorised hashing of the words of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of about this many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 1 << 20

_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2B)  # 3 modulo 8: its powers differ by few factors of two
_LINEAR = _DRAW.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread one-to-one image of 64-bit numbers."""
    x = (x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of some texts: 64-bit hash, number of the text, first byte and end in ``data``."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def runs(self, texts: int) -> np.ndarray:
        """Where each text's words begin, and the end of the last."""
        return np.searchsorted(self.text, np.arange(texts + 1))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words (runs without ASCII white space) of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    first, last = int(offsets[0]), int(offsets[-1])
    cuts = [first]
    while cuts[-1] < last:  # slices end where a word ends
        at = min(cuts[-1] + SLICE_BYTES, last)
        while at < last:
            step = np.flatnonzero(_BLANK[data[at : min(last, at + 4096)]])
            if len(step):
                at += int(step[0])
                break
            at = min(last, at + 4096)
        cuts.append(at)
    hashes, starts, ends = [], [], []
    bounds = np.unique(offsets)
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        word = ~_BLANK[part]
        edge = np.zeros(b - a + 1, bool)
        inside = bounds[(bounds >= a) & (bounds < b)] - a
        edge[inside] = True
        edge[0] = True
        edge[-1] = True
        begins = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
        stops = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
        values = _BYTE[_LOWER[part] if lower else part]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, b - a), out=sums[1:])
        inverse = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), b - a)
        hashes.append(mixed((sums[stops] - sums[begins]) * inverse[begins]))
        starts.append(begins + a)
        ends.append(stops + a)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    start = join(starts, np.int64)
    return Words(
        join(hashes, np.uint64), np.searchsorted(offsets, start, "right") - 1, start, join(ends, np.int64), data
    )


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """One hash for each window of ``size`` consecutive hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : n + k] * _LINEAR[(k + 7 * salt) % 64]
    return mixed(out, salt + size)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` for slices of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data, offsets[row : end + 1]
        row = end
