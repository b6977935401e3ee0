"""Cuts texts into chunks whose tokens don't depend on their neighbours, each encoded once.

A pre-token never reaches from a character that is no white space into a space after it.
So a text may be cut before each single space between two such characters; the chunks of
a batch are looked up by a hash and then by their bytes, and only chunks a worker hasn't
met yet are tokenised. White space is that of any script.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sensorflow.llm import words as W

# Entries a worker holds at most (about 200 MB); beyond, it starts anew. No result depends on it.
CACHE_ENTRIES = 1_500_000

# Fixed: characters of three UTF-8 bytes that some Unicode version counts as white space.
_WIDE_WHITE = np.zeros(0x3000, dtype=bool)
_WIDE_WHITE[[c - 0x1000 for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]] = True

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def white_space(data: np.ndarray) -> np.ndarray:
    """True at each byte of a white-space character, separators and blank marks included."""
    white = W.SPACE[data]
    white |= (data >= 0x1C) & (data <= 0x1F)
    n = len(data)
    two = np.flatnonzero(data[: n - 1] == 0xC2)
    two = two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]
    three = np.flatnonzero((data[: max(n - 2, 0)] >= 0xE1) & (data[: max(n - 2, 0)] <= 0xE3))
    point = (data[three] & 15).astype(np.int32) << 12
    point |= (data[three + 1] & 63).astype(np.int32) << 6 | (data[three + 2] & 63)
    three = three[_WIDE_WHITE[point - 0x1000]]
    for start, size in ((two, 2), (three, 3)):
        for k in range(size):
            white[start + k] = True
    return white


def chunk_spans(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk; together they cover all bytes."""
    data, n = texts.data, len(texts.data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        solid = ~white_space(data)
        cut[1 : n - 1] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
    cut[texts.bounds] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.append(starts[1:], n)


ragged = W.ragged


class Cache:
    """Token ids of spans, found by a hash of their bytes and then by the bytes themselves."""

    def __init__(self, encode: Encode, most: int = CACHE_ENTRIES):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.text_starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.texts = np.zeros(0, dtype=np.uint8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.slots[at], self.keys[at] == keys

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes the pieces and stores them in new entries."""
        ids, lengths = self.encode(pieces)
        first = len(self.starts)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        ends = self.text_starts[-1] + np.cumsum([len(p) for p in pieces])
        self.text_starts = np.append(self.text_starts, ends)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.texts = np.append(self.texts, np.frombuffer(b"".join(pieces), dtype=np.uint8))
        return np.arange(first, len(self.starts))

    def unlike(self, data: np.ndarray, starts, ends, slots) -> np.ndarray:
        """The spans whose bytes are not those of their entry."""
        lengths = ends - starts
        wrong = lengths != self.text_starts[slots + 1] - self.text_starts[slots]
        at = np.flatnonzero(~wrong)
        places = ragged(self.text_starts[slots[at]], lengths[at])
        covering = len(at) == len(starts) and len(at) and len(places) == ends[-1] - starts[0]
        own = data[starts[0] : ends[-1]] if covering else data[ragged(starts[at], lengths[at])]
        differ = np.flatnonzero(self.texts[places] != own)
        if len(differ):
            wrong[at[np.searchsorted(np.cumsum(lengths[at]), differ, side="right")]] = True
        return np.flatnonzero(wrong)

    def place(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Where each span's ids stand in `self.ids`: start and length."""
        keys, first, inverse = np.unique(
            W.hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        slots, known = self.find(keys)
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > self.most:
                self.clear()
                known[:] = False
            slots[~known] = self.add(self._cut(data, starts, ends, first[~known]))
            where = np.searchsorted(self.keys, keys[~known])
            self.keys = np.insert(self.keys, where, keys[~known])
            self.slots = np.insert(self.slots, where, slots[~known])
        slots = slots[inverse]
        wrong = self.unlike(data, starts, ends, slots)
        if len(wrong):
            pieces = self._cut(data, starts, ends, wrong)
            entry = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            fresh = self.add(list(entry))
            slots[wrong] = fresh[[entry[p] for p in pieces]]
        return self.starts[slots], self.lengths[slots]

    @staticmethod
    def _cut(data, starts, ends, which) -> list[bytes]:
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())]


def per_text(texts: W.Texts, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum over each text of one value per span."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.searchsorted(starts, texts.bounds)])
