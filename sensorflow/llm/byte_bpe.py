"""Byte-level BPE by backtracking over longest matches, and its inverse.

Bytes are read as Latin-1, so an Aho-Corasick automaton finds every token that starts at
every place of a pre-token. The encoder takes the longest one whose predecessor allows
it, and steps back where none does. Two neighbours are allowed if merging their joined
bytes by rank gives just these two; this is memoised. A sequence whose neighbours all
allow each other is the one that merging gives, and a place that led nowhere is never
tried again, so the work is linear in the length.

Null and empty texts give no tokens. Special tokens are not read. Texts are whole;
one long pre-token costs time in proportion to its length. Letters newer than the Unicode
tables of the installed `regex` or tiktoken may be split otherwise. Repeated rows and null ids
pass through row by row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm import words as W
from sensorflow.llm.chunks import Cache, chunk_spans, per_text, ragged
from sensorflow.llm.tables import in_workers

SCHEMA = "doc_id long, ids array<long>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.allowed: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # A token that its own bytes don't merge into occurs only as a whole pre-token.
            merged, last = self._merge(token)
            if merged == [rank]:
                self.matches.add_word(token.decode("latin-1"), (rank, len(token)))
                if last:
                    self.halves[rank] = last
        self.matches.make_automaton()
        sizes = np.zeros(max(self.bytes_of, default=-1) + 1, dtype=np.int64)
        for rank, token in self.bytes_of.items():
            sizes[rank] = len(token)
        self.sizes, self.places = sizes, np.cumsum(sizes) - sizes
        self.store = np.frombuffer(
            b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), dtype=np.uint8
        )

    def merge(self, data: bytes) -> list[int]:
        """Merging by rank, for the few bytes of one or two tokens."""
        return self._merge(data)[0]

    def _merge(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The merged tokens, and the pair that merged last."""
        parts = [data[i : i + 1] for i in range(len(data))]
        last = None
        while len(parts) > 1:
            found = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == len(self.ranks):
                break
            i = found.index(best)
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], last and (self.ranks[last[0]], self.ranks[last[1]])

    def allows(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.allowed.get(pair)
        if known is None:
            if len(self.allowed) > 1_000_000:
                self.allowed.clear()
            known = self.allowed[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens never merges across their border.

        Read backwards from the end: the later of the two merges that made the tokens at
        the border is undone, and what then stands at the border must not merge sooner.
        Of equal ranks the one further left merges first.
        """
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        sooner_than = len(ranks)
        while True:
            crossing = ranks.get(bytes_of[left] + bytes_of[right])
            if crossing is not None and crossing < sooner_than:
                return False
            if left > right and left in halves:
                sooner_than, left = left, halves[left][1]
            elif right in halves:
                sooner_than, right = right + 1, halves[right][0]
            elif left in halves:
                sooner_than, left = left, halves[left][1]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        untried: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, (rank, n) in self.matches.iter(piece.decode("latin-1")):
            untried[last - n + 1].append((last + 1, rank))
        tokens: list[int] = []
        stops = [0]
        dead = bytearray(size + 1)
        while stops[-1] < size:
            left = untried[stops[-1]]
            while left:
                stop, rank = left.pop()  # the longest comes last
                if not dead[stop] and (not tokens or self.allows(tokens[-1], rank)):
                    tokens.append(rank)
                    stops.append(stop)
                    break
            else:
                if not tokens:
                    raise ValueError("a byte has no token")
                dead[stops.pop()] = 1
                tokens.pop()
        return tokens

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        lengths = np.zeros(len(chunks), dtype=np.int64)
        for k, chunk in enumerate(chunks):
            before = len(ids)
            for piece in self.pattern.findall(chunk.decode("utf-8")):
                ids += self.encode_piece(piece.encode("utf-8"))
            lengths[k] = len(ids) - before
        return np.array(ids, dtype=np.uint32), lengths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        return self.store[ragged(self.places[ids], self.sizes[ids])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def _cached(path: str, pattern: str) -> tuple[Encoder, Cache]:
    encoder = Encoder(read_ranks(path), pattern)
    return encoder, Cache(encoder.encode_chunks)


def encoded(texts: W.Texts, known: Cache) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice, and where each text's ids begin, with the end of the last."""
    starts, ends = chunk_spans(texts)
    at, lengths = known.place(texts.data, starts, ends)
    counts = per_text(texts, starts, lengths)
    return known.ids[ragged(at, lengths)], np.concatenate([[0], np.cumsum(counts)])


def _encode(batches, path, pattern):
    _, known = _cached(path, pattern)
    for batch in batches:
        row = 0
        for texts in W.slices(batch.column(1)):
            ids, bounds = encoded(texts, known)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, texts.count), lists], names=["doc_id", "ids"]
            )
            row += texts.count


def _decode(batches, path, pattern):
    encoder, _ = _cached(path, pattern)
    for batch in batches:
        out = []
        for ids in batch.column(1).to_pylist():
            out.append(encoder.decode(np.array(ids or [], dtype=np.int64)).tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def _digest(batches, path, pattern):
    encoder, known = _cached(path, pattern)
    for batch in batches:
        counts, digests, decoded = [], [], []
        for texts in W.slices(batch.column(1)):
            ids, bounds = encoded(texts, known)
            raw = memoryview(ids.astype("<u4").tobytes())
            back = memoryview(encoder.decode(ids).tobytes())
            sizes = np.concatenate([[0], np.cumsum(encoder.sizes[ids])])[bounds].tolist()
            counts.append(np.diff(bounds))
            bounds = (4 * bounds).tolist()
            for a, z, c, e in zip(bounds, bounds[1:], sizes, sizes[1:]):
                digests.append(hashlib.sha256(raw[a:z]).hexdigest())
                decoded.append(hashlib.sha256(back[c:e]).hexdigest())
        if digests:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(counts), pa.int64()),
                    pa.array(digests),
                    pa.array(decoded),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every document."""
    return _texts(docs).mapInArrow(in_workers(_encode, path=path, pattern=pattern), SCHEMA)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of every row of ids; bytes that are no UTF-8 become U+FFFD."""
    rows = tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>"))
    return rows.mapInArrow(in_workers(_decode, path=path, pattern=pattern), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each document's ids, and of the bytes that they decode to."""
    return _texts(docs).mapInArrow(in_workers(_digest, path=path, pattern=pattern), DIGESTS)
