"""Quality rules by host: failures per domain, shrunk by a beta prior, joined back.

Every document is measured once. The failures of each rule are summed by host, a beta
prior is fitted to the hosts' rates by moments, and each host's rate becomes the mean of
its posterior. A host one of whose rates is above `max_rate` is rejected with all its
documents; a small host stays near the prior, so a few bad documents don't condemn it.

Null text counts as a text without words. A null host is a host of its own. Rows that
repeat are measured and counted each. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.llm import words as W
from sensorflow.llm.tables import in_workers, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """What a document fails by; the host's rates are kept for each rule."""
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "long_words": F.col("word_chars") > 40 * F.col("n_words"),
    }


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and which of them equal the one before."""
    order = np.argsort(keys, kind="stable")
    return order, np.diff(keys[order], prepend=keys[order[:1]] + np.uint64(1)) == 0


def measure_slice(texts: W.Texts) -> list[np.ndarray]:
    """The measures of each text, in the order of MEASURES."""
    n, data = texts.count, texts.data
    starts, ends = W.words(texts)
    owner = texts.text_of(starts)
    in_word = ~W.SPACE[data]

    line_starts, line_ends = W.spans(texts, data == 10)
    inside = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[inside > 0], line_ends[inside > 0]
    line_owner = texts.text_of(line_starts)
    salt = W.mixed(np.arange(n, dtype=np.uint64))
    order, same = _repeats(W.hashes(data, line_starts, line_ends) + salt[line_owner])
    at = np.flatnonzero(same)
    a, b = order[at - 1], order[at]
    same[at] = W.same_bytes(data, line_starts[a], line_ends[a], line_starts[b], line_ends[b])

    runs = W.windows(W.hashes(data, starts, ends), WINDOW)
    last = WINDOW - 1
    runs_owner = owner[: len(runs)]
    whole = runs_owner == owner[last : last + len(runs)]
    at = np.flatnonzero(whole)
    run_order, again = _repeats(runs[at] + salt[runs_owner[at]])
    twice = again.copy()
    twice[:-1] |= again[1:]
    begin = at[run_order[twice]]
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    return [
        np.bincount(owner, minlength=n),
        texts.per_text(in_word & W.lead_bytes(data)),
        texts.per_text(_SYMBOL[data]),
        np.bincount(line_owner, minlength=n),
        np.bincount(line_owner[order[same]], minlength=n),
        np.bincount(owner[covered], minlength=n),
    ]


def _measure(batches):
    for batch in batches:
        parts = [measure_slice(t) for t in W.slices(batch.column(2))]
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, columns)],
                names=["doc_id", "host", *MEASURES],
            )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and MEASURES of every document."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string")
    ).mapInArrow(
        in_workers(_measure), "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    )


def host_rates(measures: DataFrame) -> DataFrame:
    """Per host: n_docs and the shrunk failure rate `rate_<rule>` of each rule."""
    named = rules()
    counts = written(
        measures.groupBy("host").agg(
            F.count("*").alias("n_docs"),
            *(F.count_if(rule).alias(f"k_{name}") for name, rule in named.items()),
        ),
        "hosts",
    )
    n = F.col("n_docs")
    total = [F.sum(n).alias("n"), F.count("*").alias("hosts")]
    spread = [
        x
        for name in named
        for x in (
            F.sum(f"k_{name}").alias(f"k_{name}"),
            F.sum(F.col(f"k_{name}") * F.col(f"k_{name}") / n).alias(f"s_{name}"),
        )
    ]
    corpus = counts.agg(*total, *spread).first()
    rates = counts
    for name in named:
        a, b = _prior(corpus["n"], corpus["hosts"], corpus[f"k_{name}"], corpus[f"s_{name}"])
        rates = rates.withColumn(f"rate_{name}", (F.col(f"k_{name}") + a) / (n + a + b))
    return rates.select("host", "n_docs", *(f"rate_{name}" for name in named))


def _prior(n: int | None, hosts: int, k: int | None, square: float | None) -> tuple[float, float]:
    """Beta parameters by moments from five sums over the hosts.

    The variance between hosts is the variance of their rates, weighted by size, less
    what binomial noise alone gives. `square` is the sum of k * k / n.
    """
    if not n or not 0 < k < n:
        return (1.0, 1.0)
    mean = k / n
    noise = mean * (1 - mean)
    between = max(square / n - mean * mean - noise * hosts / n, noise / 1e4)
    strength = min(max(noise / between - 1, 1.0), 1e4)
    return mean * strength, (1 - mean) * strength


def _bad_host(max_rate: float) -> Column:
    return reduce(lambda x, y: x | y, (F.col(f"rate_{name}") > max_rate for name in rules()))


def _key(host: Column) -> Column:
    """The host as a join key; null gets a text of its own."""
    return F.when(host.isNull(), "-").otherwise(F.concat(F.lit("+"), host))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Measures, base_failed, host_rejected and kept of every document."""
    measures = written(measured(docs, host), "measures")
    verdicts = written(
        host_rates(measures).select(
            _key(F.col("host")).alias("host_key"), _bad_host(max_rate).alias("host_rejected")
        ),
        "host_verdicts",
    )
    return (
        measures.withColumn("host_key", _key(F.col("host")))
        .join(verdicts, "host_key")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("host_key", "n_lines")
    )


def _passing(batches):
    """The rows whose text passes the base rules."""
    for batch in batches:
        rows = batch.column(0)
        good = []
        for texts in W.slices(pc.struct_field(rows, "text")):
            n_words, *_, n_repeat = measure_slice(texts)
            good.append((n_words >= 10) & (100 * n_repeat <= 20 * n_words))
        yield batch.filter(pa.array(np.concatenate(good) if good else [], pa.bool_()))


def kept_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The documents that stay, with all their columns.

    Only rejected hosts are joined to the documents, as an anti-join; their table is
    written first, so Spark broadcasts it only if its size allows.
    """
    measures = written(measured(docs, host), "measures")
    rejected = written(
        host_rates(measures).where(_bad_host(max_rate)).select(_key(F.col("host")).alias("host_key")),
        "host_verdicts",
    )
    rows = docs.select(F.struct("*").alias("row"))
    return (
        rows.mapInArrow(in_workers(_passing), rows.schema)
        .withColumn("host_key", _key(F.col(f"row.{host}").cast("string")))
        .join(rejected, "host_key", "left_anti")
        .select("row.*")
    )
