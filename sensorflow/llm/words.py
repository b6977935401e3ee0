"""Words of many texts at once, on the bytes of an Arrow column.

White space is the six bytes 9 to 13 and 32. All are ASCII, so cutting UTF-8 at them is
safe. Texts are taken in slices of whole texts, so arrays stay small whatever a batch
holds; a text above the slice size makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
PIECE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_seed = np.random.default_rng(20_240_607)
# A random number for each byte at each of the first places of a span.
_NEAR = 64
_TABLE = _seed.integers(0, 2**64, (_NEAR, 256), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[:, _LOWER]
_FAR = np.uint64(0xD6E8FEB86659FD93)
_WEIGHTS = _seed.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Some texts end to end: their bytes, the bounds of each, the row of the first."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def count(self) -> int:
        return len(self.bounds) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """The number of the text that holds each byte position."""
        return np.searchsorted(self.bounds, places, side="right") - 1


def slices(column: pa.Array) -> Iterator[Texts]:
    """The texts of a string column, null as empty, a few megabytes at a time."""
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(array):
        return
    _, ends, data = array.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, side="right")) - 1)
        yield Texts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


def spans(texts: Texts, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes that are no gap, inside one text."""
    n = len(gap)
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.bounds] = True
    solid = ~gap
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
    """A 64-bit hash of each span; `lower` reads A-Z as a-z.

    It is the sum of a random number for each byte at its place in the span. Spans are in
    rising order, not empty, and don't overlap.
    """
    table = (_LOWER_TABLE if lower else _TABLE).ravel()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        lengths = ends[i:j] - starts[i:j]
        begins = np.cumsum(lengths) - lengths
        total = int(begins[-1] + lengths[-1])
        place = np.arange(total) - np.repeat(begins, lengths)
        if total == int(ends[j - 1]) - base:
            letters = data[base : base + total]
        else:
            letters = data[np.repeat(starts[i:j], lengths) + place]
        if int(lengths.max()) <= _NEAR:
            values = table[place << 8 | letters]
        else:
            values = table[np.minimum(place, _NEAR - 1) << 8 | letters]
            far = np.flatnonzero(place >= _NEAR)
            code = _LOWER[letters[far]] if lower else letters[far]
            values[far] = mixed((place[far] << 8 | code).astype(np.uint64) * _FAR)
        out[i:j] = np.add.reduceat(values, begins)
        i = j
    return mixed(out + (ends - starts).astype(np.uint64) * _WEIGHTS[63])


def same_bytes(data: np.ndarray, starts, ends, other_starts, other_ends) -> np.ndarray:
    """Whether each span holds the bytes of its counterpart."""
    lengths = ends - starts
    out = lengths == other_ends - other_starts
    at = np.flatnonzero(out & (lengths > 0))
    if len(at):
        n = lengths[at]
        unlike = data[ragged(starts[at], n)] != data[ragged(other_starts[at], n)]
        out[at] = ~np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    return out


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` neighbouring hashes."""
    n = max(0, len(values) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += values[k : k + n] * _WEIGHTS[k]
    return mixed(total)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return spans(texts, SPACE[texts.data])


def lead_bytes(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
