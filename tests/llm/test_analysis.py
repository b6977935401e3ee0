"""Filter audits, exact search and alignment, against plain versions."""

import bisect
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorflow.llm import alignment, filter_audit, topk_search
from sensorflow.llm.token_counts import byte_letters
from tests.llm import support as S

LABELS = "doc_id long, quality int, toxic int"


# Filter audit ---------------------------------------------------------------


def failures(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, _ in rows:
        text = text or ""
        words = S.WORDS.findall(text)
        yield {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > first[text],
        }


def audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for (doc_id, _, source), failed in zip(rows, failures(rows)):
        parts[source or ""].append((doc_id, failed))
    out = {}
    for part, docs in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            live = docs
            for step, f in enumerate(order, 1):
                gone = [d for d, x in live if x[f]]
                live = [(d, x) for d, x in live if not x[f]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(live), len(gone), sum(x[f] for _, x in docs) - len(gone),
                    sum(x[f] and sum(x.values()) == 1 for _, x in docs),
                    sum(d in good for d in gone), sum(d in toxic for d in gone), f,
                ]
        for key, found in out.items():
            if key[0] == part:
                found[-1] = share[found[-1]]
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = S.nasty() + S.prose(40, words=600) + ["w " * 300, "Aa Bb $5 " * 80, "Aa Bb $5 " * 80]
    rows = [(i, rng.choice(texts), rng.choice(["x", "x", "x", "y", None, ""])) for i in range(300)]
    rows += [(7, "again", "x"), (7, "again", "y"), (9, "again", "x"), (None, "again", "y"), (None, "again", "y")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = S.clashing(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], S.SCHEMA).repartition(4))
    docs = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "digest", "first", "good", "quality")})
    tags = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1))
    found = filter_audit.audited(docs, tags).collect()
    expected = audit(rows, labels)
    assert len(found) == len(expected) == 600 * 3
    for r in found:
        assert list(r[3:]) == expected[r.part, r.filter_order, r.step], r
    for empty in (tags.where("false"), tags):
        assert filter_audit.audited(docs.where("false"), empty).count() == 0


def test_counts_near_the_limit_of_a_long():
    rows = [{"mask": m, "good": True, "toxic": False, "n": 2**57} for m in range(32)]
    found = filter_audit.table(rows)
    assert (found["kept"] + found["removed"] <= 2**62).all()
    assert all(found["kept"][i] == 2**57 * 16 for i in range(0, 600, 5))


# Exact search ---------------------------------------------------------------


def whole(vector):
    if vector is None or any(v is None or not np.isfinite(v) for v in vector):
        return None
    return [int(np.floor(64 * float(np.float32(v)))) for v in vector]


def nearest(rows, k, every):
    points = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for i, x in points:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in points if j != i)
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    scale = rng.lognormal(0, 1, (n, 1))
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (n, width)) * scale)]


@pytest.mark.parametrize("slab, asked, head, block", [(1 << 21, 1 << 18, 1 << 17, 512), (16 * 40, 16 * 9, 16 * 30, 7)])
def test_top_k(spark, monkeypatch, slab, asked, head, block):
    for name, value in (("SLAB_VALUES", slab), ("QUERY_VALUES", asked), ("HEAD_VALUES", head), ("BLOCK", block)):
        monkeypatch.setattr(topk_search, name, value)
    rows = vectors(300, 16, 1)
    same = [0.5, -0.25] * 8
    rows += [(300 + i, same) for i in range(150)] + [(1000, [0.0] * 16), (1001, [0.0] * 16)]
    rows += [(20, same), (41, same), (41, same), (None, same), (60, None), (2000, [None] + [1.0] * 15), (2020, [float("nan")] + [9.0] * 15), (2040, [float("inf")] * 16)]
    rows += [(2060, [9.0]), (2080, []), (-20, [-1.5] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    frame = frame.withColumns({c: F.lit("x") for c in ("x", "query", "length", "floor", "score", "class", "rank", "part")})
    found = topk_search.top_k(frame, 20, F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == nearest(rows, 20, 20)


def test_top_k_of_few_and_of_none(spark):
    frame = spark.createDataFrame(vectors(5, 3, 2), "vec_id long, embedding array<float>")
    is_query = F.col("vec_id") % 20 == 0
    assert sorted(map(tuple, topk_search.top_k(frame, 20, is_query).collect())) == nearest(vectors(5, 3, 2), 20, 20)
    for none in (frame.where("false"), frame.where("vec_id = 0"), frame.where("vec_id > 0")):
        assert topk_search.top_k(none, 20, is_query).count() == 0


def test_large_components_are_multiplied_in_longs(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 3.0]), (3, [2e7 + 1, 1e7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(64 * v) for v in x] for i, x in rows}
    found = topk_search.top_k(frame, 2, F.col("vec_id") == 0).collect()
    scores = sorted(((-sum(a * b for a, b in zip(exact[0], exact[j])), j) for j in (1, 2, 3)))[:2]
    assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(-s, j) for s, j in scores]


# Alignment ------------------------------------------------------------------

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def alignments(texts):
    left = Tokenizer.from_file(BYTES)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    docs, count = [], Counter()
    for text in texts:
        text = text or ""
        whole = (" " + text).encode()
        a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        a_bytes = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
        pieces = [right.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(None)
            continue
        a_spans, b_spans = spans(a_bytes), spans(b_bytes)
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups = [([], []) for _ in ends]
        for side, ids, places in ((0, a, a_spans), (1, b, b_spans)):
            for i, (_, end) in zip(ids, places):
                groups[bisect.bisect_left(ends, end)][side].append(str(i))
        links = []
        for i, (start, end) in zip(a, a_spans):
            for j, (s, e) in zip(b, b_spans):
                if s < end and start < e:
                    links.append((j, i))
        count.update(links)
        docs.append((len(a), len(b), len(ends), links, S.sha(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups))))
    top = defaultdict(int)
    for (j, _), n in count.items():
        top[j] = max(top[j], n)
    return [
        (0,) * 6 + ("",) if d is None else (*d[:3], len(d[3]), sum(count[x] == top[x[0]] for x in d[3]), sum(count[x] for x in d[3]), d[4])
        for d in docs
    ]


def mixed():
    rng = random.Random(6)
    atoms = ["a", "the", " ", " ", "  ", "\n", "'s", "1", "23", "é", "ß", "̸", "=", ".", ",", "#", " ", "　", "X", "ing", "<|endoftext|>", "İ", "Σ", "🙂", "中", "<0x41>", "<s>", "\x00", "\t"]
    drawn = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [t for t in S.nasty() if len(t or "") < 4000] + S.prose(30) + drawn + ["▁", "a▁ b", "x ▁y", "good and ▁ bad"] + ["the same text"] * 60


@pytest.mark.parametrize("links, fan, at_once", [(1 << 21, 256, 64), (300, 3, 2)])
def test_alignment(spark, monkeypatch, links, fan, at_once):
    for name, value in (("FAN", fan), ("RUNS_AT_ONCE", at_once)):
        monkeypatch.setattr(alignment, name, value)
    given = mixed()
    docs = S.clashing(S.documents(spark, [*enumerate(given), (5, "repeated id"), (None, "no id")]))
    docs = docs.withColumns({c: F.lit("x") for c in ("run", "kind", "radix", "data", "slot")}).repartition(9)
    found = [tuple(r) for r in alignment.aligned(docs, BYTES, PIECES, run_links=links).collect()]
    ids = [*range(len(given)), 5, None]
    expected = [(i, *e) for i, e in zip(ids, alignments([*given, "repeated id", "no id"]))]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(e[1] > 0 for e in expected) > 150 and sum(e[1] == 0 for e in expected) > 5


def test_alignment_of_nothing(spark):
    docs = S.documents(spark, ["a", None, ""])
    assert alignment.aligned(docs.where("false"), BYTES, PIECES).count() == 0
    rows = alignment.aligned(docs.where("text IS NULL OR text = ''"), BYTES, PIECES).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_small_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 40)
    aligner = alignment.Aligner(BYTES, PIECES)
    import pyarrow as pa

    from sensorflow.llm import words

    given = [t for t in S.prose(60) for _ in range(2)]
    sizes = []
    for text in given:
        for texts in words.slices(pa.array([" " + text])):
            sizes += aligner.slice(texts)[0].tolist()
    assert [tuple(s) for s in sizes] == [e[:4] for e in alignments(given)]
