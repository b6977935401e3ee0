"""How filters interact: what each removes in every order they could be applied in.

A document's failures are a mask of one bit per filter. Every mask maps to one big integer
with a 64-bit field for each outcome (removed, kept, redundant) of each of the 600 steps of
the 120 orders. Documents are counted by part, mask and labels, so what travels is bounded
by the number of parts; a part's integers, times these counts, are summed as they are and
unpacked once. No field can run over, since a count of rows fits a long.

Null text counts as empty, a null part as the empty text. Filter E fails where a smaller
doc_id has the identical text, by SHA-256; a row with a null id never fails it, nor does a
row that repeats the smallest id. Rows that repeat count each. Several labels of one id
count as one that holds any of theirs; without a label nothing is lost. Words are told
apart by 64-bit hashes. An empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm import words as W
from sensorflow.llm.tables import in_workers, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARKED = np.zeros(256, dtype=bool)
_MARKED[list(b"#$%&*|")] = True

COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


# Masks ----------------------------------------------------------------------


def masks(texts: W.Texts) -> np.ndarray:
    """The bits of filters A to D for each text; E needs the whole table."""
    n, data = texts.count, texts.data
    starts, ends = W.words(texts)
    owner = texts.text_of(starts)
    n_words = np.bincount(owner, minlength=n)
    keys = W.hashes(data, starts, ends) + W.mixed(np.arange(n, dtype=np.uint64))[owner]
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(owner[first], minlength=n)
    failed = (
        n_words < 200,
        100 * distinct < 50 * n_words,
        100 * texts.per_text(_UPPER[data]) > 2 * texts.per_text(W.lead_bytes(data)),
        texts.per_text(_MARKED[data]) > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def _mark(batches):
    for batch in batches:
        found, digests = [np.zeros(0, dtype=np.int32)], []
        for texts in W.slices(batch.column(2)):
            found.append(masks(texts))
            raw, bounds = memoryview(texts.data), texts.bounds.tolist()
            digests += [hashlib.sha256(raw[a:b]).digest() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.concatenate(found))],
            names=["doc_id", "part", "digest", "mask"],
        )


def marked(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, digest and mask of every document, all five filters judged."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string"),
    )
    marks = written(
        rows.mapInArrow(in_workers(_mark), "doc_id long, part string, digest binary, mask int"), "marks"
    )
    # The first of each text is met by digest and id together, so no group of copies is one key.
    firsts = marks.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    is_copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return marks.join(firsts.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left").select(
        "doc_id", "part", "digest", (F.col("mask") + F.when(is_copy, COPY).otherwise(0)).alias("mask")
    )


# Counters -------------------------------------------------------------------


@cache
def _wide() -> list[int]:
    """For each mask: removed, kept and redundant of all steps, 64 bits each."""
    out = []
    for mask in range(1 << len(FILTERS)):
        removed, kept, redundant = [], [], []
        for order, step in STEPS:
            fails = [mask >> FILTERS.index(letter) & 1 for letter in order[:step]]
            earlier = any(fails[:-1])
            removed.append(fails[-1] and not earlier)
            kept.append(not any(fails))
            redundant.append(fails[-1] and earlier)
        fields = np.array(removed + kept + redundant, dtype="<u8")
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def _unpacked(total: int) -> np.ndarray:
    size = 3 * len(STEPS)
    return np.frombuffer(total.to_bytes(8 * size, "little"), dtype="<i8").reshape(3, -1)


def table(rows: list[dict]) -> dict[str, np.ndarray]:
    """The counts of all steps for one part, from its number of rows by mask and labels."""
    wide = _wide()
    every = sum(r["n"] * wide[r["mask"]] for r in rows)
    good = sum(r["n"] * wide[r["mask"]] for r in rows if r["good"])
    toxic = sum(r["n"] * wide[r["mask"]] for r in rows if r["toxic"])
    removed, kept, redundant = _unpacked(every)
    at = np.array([FILTERS.index(order[step - 1]) for order, step in STEPS])
    alone = np.zeros(len(FILTERS), dtype=np.int64)
    for r in rows:
        if r["mask"].bit_count() == 1:
            alone[r["mask"].bit_length() - 1] += r["n"]
    share = np.array([removed[at == i].sum() for i in range(len(FILTERS))])
    return {
        "kept": kept,
        "removed": removed,
        "redundant": redundant,
        "unique_fails": alone[at],
        "good_lost": _unpacked(good)[0],
        "toxic_lost": _unpacked(toxic)[0],
        "shapley": share[at],
    }


def _unpack(batches):
    orders = pa.array([order for order, _ in STEPS])
    steps = pa.array([step for _, step in STEPS], pa.int32())
    for batch in batches:
        for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = table(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(STEPS)), orders, steps, *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                names=["part", "filter_order", "step", *COUNTS],
            )


def audited(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with COUNTS."""
    flags = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    )
    counts = (
        marked(docs, part)
        .join(flags, "doc_id", "left")
        .groupBy("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
        .agg(F.count("*").alias("n"))
    )
    # At most 128 rows a part: masks times labels.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("rows"))
    return parts.mapInArrow(in_workers(_unpack), RESULT)
