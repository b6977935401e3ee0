"""Token counts by merging many pre-tokens at once, rank by rank.

Pre-tokens are held as one flat array of symbols with the number of their sequence. In
each step every sequence finds its lowest-ranked pair, all occurrences of it merge from
the left, and sequences without a pair leave with the symbols they have. Only pairs
beside a merge are looked up again.

Null and empty texts have no bytes and no tokens. The tokenizer's special strings inside
a text count as one token each. Texts are neither cut nor padded. Repeated rows and null
ids pass through row by row; other columns are not read.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm import words as W
from sensorflow.llm.chunks import Cache, chunk_spans, per_text
from sensorflow.llm.tables import in_workers

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
NEVER = np.iinfo(np.int32).max
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

# Fixed: how byte-level pre-tokenisers split text.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class Merges:
    """Rank and product of symbol pairs, in an open hash table."""

    def __init__(self, pairs: np.ndarray, products: np.ndarray):
        bits = max(4, int(len(pairs) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NEVER, dtype=np.int32)
        self.products = np.append(products, 0).astype(np.int64)
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1].astype(np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & self.mask
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NEVER)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def surviving(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many symbols each sequence has when no pair is left. Lengths are at least 1."""
    counts = lengths.astype(np.int64).copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = symbols.astype(np.int64)
    ranks = np.full(len(symbols), NEVER, dtype=np.int32)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inner] = merges.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        size = np.diff(np.append(first, len(owner)))
        least = np.minimum.reduceat(ranks, first)
        live = least < NEVER
        if not live.all():
            keep = np.repeat(live, size)
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            least, size = least[live], size[live]
            if not len(symbols):
                break
        hit = ranks == np.repeat(least, size)
        # Of hits side by side (as in a run of one symbol) every second one merges.
        start = hit.copy()
        start[1:] &= ~hit[:-1]
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(start, place, 0))
        take = np.flatnonzero(hit & ((place - run) % 2 == 0))
        symbols[take] = merges.products[ranks[take]]
        np.subtract.at(counts, owner[take], 1)
        stay = np.ones(len(symbols), dtype=bool)
        stay[take + 1] = False
        moved = np.cumsum(stay)[take] - 1
        symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
        # A merged symbol meets its neighbours anew.
        again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        ranks[again] = NEVER
        again = again[again < len(symbols) - 1]
        again = again[owner[again] == owner[again + 1]]
        ranks[again] = merges.rank(symbols[again], symbols[again + 1])
    return counts


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Counter:
    """Counts by the vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(
            np.array([[vocab[a], vocab[b]] for a, b in pairs], dtype=np.int64).reshape(-1, 2),
            np.array([vocab[a + b] for a, b in pairs], dtype=np.int64),
        )
        self.symbol_of = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(BYTE_LEVEL)
        self.known = Cache(self.count_chunks)

    def count_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each chunk, as the cache wants it: no ids, but their numbers."""
        counts = np.zeros(len(chunks), dtype=np.int64)
        pieces: list[bytes] = []
        owner: list[int] = []
        for k, chunk in enumerate(chunks):
            parts = [text := chunk.decode("utf-8")]
            if "<" in text:
                parts = self.special.split(text)
                counts[k] = len(parts) - 1
            for part in parts:
                found = self.pattern.findall(part)
                pieces += [p.encode("utf-8") for p in found]
                owner += [k] * len(found)
        if pieces:
            symbols = self.symbol_of[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
            left = surviving(self.merges, symbols, np.array([len(p) for p in pieces]))
            counts += np.bincount(owner, weights=left, minlength=len(chunks)).astype(np.int64)
        return np.zeros(0, dtype=np.uint32), counts


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def _count(batches, path):
    counter = _counter(path)
    for batch in batches:
        sizes, counts = [], []
        for texts in W.slices(batch.column(1)):
            starts, ends = chunk_spans(texts)
            _, lengths = counter.known.place(texts.data, starts, ends)
            sizes.append(np.diff(texts.bounds))
            counts.append(per_text(texts, starts, lengths))
        if sizes:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.concatenate(x), pa.int64()) for x in (sizes, counts))],
                names=["doc_id", "n_bytes", "n_tokens"],
            )


def counted(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(in_workers(_count, path=path), SCHEMA).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
