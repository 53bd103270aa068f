"""Words of many texts at once: positions and 64-bit hashes straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything ASCII but letters and digits.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BLOCK = 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BYTE_LOWER = _BYTE[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base, or of its inverse, modulo 2^64. Longer tables are kept for the next call."""
    if len(_powers[inverse]) < n:
        base = np.uint64(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE
        table = np.full(max(n, _BLOCK + 1), base)
        table[0] = 1
        _powers[inverse] = np.multiply.accumulate(table)
    return _powers[inverse][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts (one more entry than texts); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([pa.array([], pa.large_string()), *column.cast(pa.large_string()).chunks])
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def sliced(batches, column: int, limit: int = 1 << 22):
    """The same rows in smaller batches, each of about ``limit`` bytes of text or one longer text, to bound memory."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else [0]
        for a, b in zip(first, [*first[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Of a batch of texts: hash, byte start and byte end of each word, and the first word of each text (n + 1 entries)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))


def words(column, gap: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Maximal runs of bytes outside ``gap`` (ASCII only, so characters stay whole), A-Z lower-cased for the hash if asked."""
    data, offsets = utf8(column)
    gap = gap[LOWER] if lower else gap  # letters count as what they become
    starts, ends, hashes = [], [], []
    breaks = np.unique(offsets)
    at = 0
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        if stop < len(data):  # move the end of the block to a place between words
            later = breaks[np.searchsorted(breaks, stop)]
            while stop < later:
                found = np.flatnonzero(gap[data[stop : min(stop + 65536, later)]])
                if len(found):
                    stop += int(found[0])
                    break
                stop = min(stop + 65536, int(later))
        block = data[at:stop]
        inside = ~gap[block]
        new = np.zeros(len(block) + 1, bool)
        new[0] = new[-1] = True
        new[breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, stop)] - at] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | new[1:-1]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | new[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        if len(s):
            size = e - s
            own = block[inside]
            first = np.cumsum(size) - size
            value = (_BYTE_LOWER if lower else _BYTE)[own] * powers(len(own))
            hashes.append(mix(np.add.reduceat(value, first) * powers(len(own), True)[first] + size.astype(np.uint64) * _GOLDEN))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offsets), data)


_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN + _BASE) | np.uint64(1)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 entries run over the end and mean nothing."""
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        weight = _WEIGHTS[k]
        total[: len(hashes) - k] += hashes[k:] * weight
        total ^= total >> np.uint64(29)
    return mix(total)
