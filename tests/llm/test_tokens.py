"""Tokenisation and packing, against the libraries."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorflow.llm import byte_bpe, chunks, packing, token_counts, words
from tests.llm import support as S


def texts():
    rng = random.Random(6)
    atoms = ["a", "the", " ", " ", "  ", "\n", "'s", "1", "23", "é", "ß", "̸", "=", ".", ",", "#", "\u00a0", "\u3000", "X", "ing", "<|endoftext|>", "İ", "Σ", "🙂", "中"]
    return S.nasty() + S.prose(30) + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_byte_bpe(spark):
    path, given = P.path("byte_bpe_multi_50k.tiktoken"), texts()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = S.clashing(S.documents(spark, given))
    expected = {i: library.encode_ordinary(t or "") for i, t in enumerate(given)}
    tokens = byte_bpe.encode(docs, path, P.PATTERN)
    assert {r.doc_id: r.ids for r in tokens.collect()} == expected
    assert {r.doc_id: r.text for r in byte_bpe.decode(tokens, path, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(given)}
    for r in byte_bpe.round_trip(docs, path, P.PATTERN).collect():
        ids = np.array(expected[r.doc_id], dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, S.sha(ids), S.sha(given[r.doc_id] or ""))


def test_neighbours_are_allowed_as_merging_says():
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rng, known = random.Random(1), list(encoder.halves)
    for _ in range(5000):
        a, b = rng.choice(known), rng.choice(known)
        assert encoder.allows(a, b) == (encoder.merge(encoder.bytes_of[a] + encoder.bytes_of[b]) == [a, b])


def test_token_counts(spark):
    path, given = P.path("byte_bpe_50k.json"), texts()
    library = Tokenizer.from_file(path)
    rows = token_counts.counted(S.clashing(S.documents(spark, given)), path, 20).collect()
    assert len(rows) == len(given)
    for r in rows:
        n = len(library.encode(given[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((given[r.doc_id] or "").encode()), n, n > 20)


def short_strings():
    atoms = [" ", "\u00a0", "\u3000", "\n", "a"]
    return ["".join(x) for n in range(7) for x in itertools.product(atoms, repeat=n)]


def test_all_short_strings_of_white_space():
    given = short_strings()
    column = pa.array(given)
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(path), P.PATTERN)
    known = chunks.Cache(encoder.encode_chunks)
    counts, ids = [], []
    for texts in words.slices(column):
        starts, ends = chunks.chunk_spans(texts)
        _, lengths = counter.known.place(texts.data, starts, ends)
        counts += chunks.per_text(texts, starts, lengths).tolist()
        found, bounds = byte_bpe.encoded(texts, known)
        ids += [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert counts == [len(e.ids) for e in library.encode_batch(given, add_special_tokens=False)]
    ranked = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    assert ids == ranked.encode_ordinary_batch(given)


def test_a_cache_tells_colliding_spans_apart(monkeypatch):
    monkeypatch.setattr(words, "hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    cache = chunks.Cache(lambda pieces: (np.array([b for p in pieces for b in p], dtype="uint32"), np.array([len(p) for p in pieces])))
    for text in (b"ab ac ad ab", b"ac ad xyz a", b"ad ab ac xyz"):
        parts = text.split(b" ")
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = ends - [len(p) for p in parts]
        at, lengths = cache.place(np.frombuffer(text, dtype=np.uint8), starts, ends)
        assert [bytes(cache.ids[a : a + n].tolist()) for a, n in zip(at, lengths)] == parts


def test_words_that_polynomials_confuse():
    one, other = S.twins()
    data = np.frombuffer(f"{one} {other}".encode(), dtype=np.uint8)
    starts, ends = np.array([0, 1025]), np.array([1024, 2049])
    assert len(set(words.hashes(data, starts, ends).tolist())) == 2
    assert len(set(words.hashes(data, starts, ends, lower=True).tolist())) == 2


def test_packing(spark):
    path, given, capacity = P.path("word_bpe_49k.json"), texts(), 64
    library = Tokenizer.from_file(path)
    docs = S.clashing(S.documents(spark, [*given, (3, "a"), (None, "no id")]))
    rows = packing.packed(docs, path, capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(given):
        if i != 3:
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
            cut = [(n, b, ids[b : b + capacity]) for n, b in enumerate(range(0, len(ids), capacity))]
            assert sorted(by_doc[i]) == [(n, b, len(p), zlib.crc32(p.tobytes())) for n, b, p in cut]
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.03 * -(-total // capacity) + 1
    assert packing.packed(docs.where("doc_id < 0"), path, capacity).count() == 0


def test_evolution_keeps_all_items_and_never_gets_worse():
    rng = random.Random(3)
    lengths = [rng.randint(20, 70) for _ in range(120)]
    first = packing.fitted(lengths, packing._falling(lengths, list(range(120))), 100)
    for packings in (packing.evolved(lengths, [], 100, "s", 6, 30), packing.evolved(lengths, [first], 100, "t", 6, 30)):
        for found in packings:
            assert sorted(i for members in found for i in members) == list(range(120))
            assert all(sum(lengths[i] for i in members) <= 100 for members in found)
        assert len(packings[0]) <= len(first)


def test_many_blocks_and_islands(spark):
    pieces = spark.range(500).select(F.col("id").alias("uid"), (F.col("id") * 37 % 90 + 5).alias("length"))
    rows = packing.placed(pieces, 100, block=60).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.uid * 37 % 90 + 5
    assert len(rows) == 500 and max(fill.values()) <= 100 and len({r.uid for r in rows}) == 500


def test_blocks_meet_again(spark):
    length = (F.col("id") * 37 % 31 + 5).cast("long")
    pieces = spark.range(1200).select(F.col("id").alias("uid"), length.alias("length"))
    fill, at = {}, {}
    for r in packing.placed(pieces, 100, block=60).collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.uid * 37 % 31 + 5
        at.setdefault(r.sequence_id, []).append((r.offset, r.uid * 37 % 31 + 5))
    total = sum(i * 37 % 31 + 5 for i in range(1200))
    assert sum(map(len, at.values())) == 1200 and max(fill.values()) <= 100 and sum(fill.values()) == total
    assert all(a + n == b for p in map(sorted, at.values()) for (a, n), (b, _) in zip(p, p[1:]))
    print("sequences", len(fill), "bound", -(-total // 100))
    assert len(fill) <= -(-total // 100) + 3
