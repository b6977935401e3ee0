"""Two tokenizers' tokens of the same bytes aligned, and how often each pair of ids meets.

Both tokenisations of a text cut the same bytes, so overlapping tokens form a staircase that
closes wherever tokens of both sides end. Texts are cut where neither tokenizer reaches
across (`chunks`); each distinct chunk is aligned once per worker. A text with a chunk
whose tokens don't give its bytes back is encoded and judged as a whole.

Pair counts go through external runs. Each task collects records (B id, A id, document,
times) of some documents, deals them by radix of the B id, and writes each part sorted as
a zstd run, with its sums per pair beside it. The sums of a radix meet in a k-way heap
merge, at most FAN runs at a time, in the order of B, then A; so all pairs of a B id pass
together, which gives its highest count on the way. The counts then stream against the
records of the same radix, some runs at a time, and what each document gets from them
goes back to the run it came from. A common id is spread over all its runs, and a merge
holds one B id of FAN runs, so memory follows the vocabulary and not the corpus.

Null and empty texts, and texts whose tokens don't give the text's bytes, have zeros and
an empty digest. Special tokens in a text are plain text. Rows that repeat, and rows with
null ids, count each. Texts are whole. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorflow.llm import words as W
from sensorflow.llm.chunks import Cache, chunk_spans
from sensorflow.llm.tables import in_workers, written
from sensorflow.llm.token_counts import byte_letters
from sensorflow.session import work_dir

RADIXES = 16
RUN_LINKS = 1 << 20
FAN = 256
RUNS_AT_ONCE = 64
CACHE_ENTRIES = 300_000
AT_ONCE = 2048

RUNS = "kind string, run long, radix int, data binary"
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "n_best long, count_sum long, groups_sha256 string"
)


# Arrays as zstd-compressed bytes --------------------------------------------


def packed(**arrays) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table(arrays)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return {name: table.column(name).to_numpy() for name in table.column_names}


# Aligning -------------------------------------------------------------------


class Side:
    """The bytes of each id, end to end."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.store = np.frombuffer(b"".join(entries), dtype=np.uint8)


def digest(groups: bytes) -> str:
    """Of the groups of a text as `align` writes them; empty without any."""
    return hashlib.sha256(groups[:-1]).hexdigest() if groups else ""


class Aligner:
    """Tokens of both sides for chunks that begin with the space that B adds."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = bytes(byte_of[c] for c in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_side, self.b_side = Side(a_bytes), Side(b_bytes)
        self.numbers = Side([b"%d," % i for i in range(max(len(a_bytes), len(b_bytes)))])
        self.clear()
        self.known = Cache(self._add, CACHE_ENTRIES)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.good = np.zeros(0, dtype=bool)
        self.sizes = np.zeros((0, 4), dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.written: list[bytes] = []

    def both(self, texts: list[str]):
        """Ids of both sides end to end, and how many each text has, a few texts at a time.

        Each text begins with the space that B puts there itself.
        """
        flat = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]]
        counts: list[list[int]] = [[], []]
        for k in range(0, len(texts), AT_ONCE):
            some = texts[k : k + AT_ONCE]
            a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            b = self.b.encode([t[1:] for t in some], num_threads=1)
            for side, ids in enumerate((a, b)):
                counts[side] += map(len, ids)
                flat[side].append(np.fromiter(chain.from_iterable(ids), dtype=np.int64))
        return [np.concatenate(f) for f in flat], [np.array(c, dtype=np.int64) for c in counts]

    def _valid(self, side: Side, ids, owner, data, bounds, good) -> None:
        """Clears `good` where the tokens of a text are not its bytes."""
        sizes = np.bincount(owner, weights=side.sizes[ids], minlength=len(good)).astype(np.int64)
        good &= sizes == np.diff(bounds)
        own = ids[good[owner]]
        made = side.store[W.ragged(side.starts[own], side.sizes[own])]
        which = np.flatnonzero(good)
        given = data[W.ragged(bounds[which], sizes[which])]
        unlike = np.flatnonzero(made != given)
        good[which[np.searchsorted(np.cumsum(sizes[which]), unlike, side="right")]] = False

    def align(self, texts: list[bytes]):
        """Of each text: whether both sides give its bytes; (n_a, n_b, n_groups, n_links);
        and the linked pairs of all, end to end, and the groups as text, each ended by `;`.
        """
        n = len(texts)
        (a, b), counts = self.both([t.decode() for t in texts])
        owners = [np.repeat(np.arange(n), c) for c in counts]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        good = np.diff(bounds) > 0
        for side, ids, owner in zip((self.a_side, self.b_side), (a, b), owners):
            self._valid(side, ids, owner, data, bounds, good)
        a, b = a[good[owners[0]]], b[good[owners[1]]]
        a_ends, b_ends = np.cumsum(self.a_side.sizes[a]), np.cumsum(self.b_side.sizes[b])
        # Between two neighbouring ends of either side lies just one overlap.
        ends = np.union1d(a_ends, b_ends)
        pairs = b[np.searchsorted(b_ends, ends)] << 32 | a[np.searchsorted(a_ends, ends)]
        closed = np.intersect1d(a_ends, b_ends, assume_unique=True)
        stops = np.cumsum(np.where(good, np.diff(bounds), 0))

        def per_text(places):
            return np.diff(np.searchsorted(places, stops, side="right"), prepend=0)

        sizes = np.stack([per_text(x) for x in (a_ends, b_ends, closed, ends)], axis=1)
        a_group, b_group = np.searchsorted(closed, a_ends), np.searchsorted(closed, b_ends)
        a_done = np.cumsum(np.bincount(a_group, minlength=len(closed)))
        b_count = np.bincount(b_group, minlength=len(closed))
        place = np.concatenate(
            [np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group], np.arange(len(b)) + a_done[b_group]]
        )
        ids, marks = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.uint8)
        ids[place] = np.concatenate([a, b])
        last = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in (a_group, b_group)]
        marks[place] = np.concatenate([np.where(last[0], ord("|"), ord(",")), np.where(last[1], ord(";"), ord(","))])
        letters = self.numbers.store[W.ragged(self.numbers.starts[ids], self.numbers.sizes[ids])]
        stop = np.cumsum(self.numbers.sizes[ids])
        letters[stop - 1] = marks
        raw = letters.tobytes()
        cuts = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes[:, 0] + sizes[:, 1])])].tolist()
        return good, sizes, pairs, [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def _add(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Aligns new chunks; their only id is their number in the arrays here."""
        if not len(self.known.starts):
            self.clear()
        first = len(self.good)
        parts = [self.align(chunks[k : k + 16 * AT_ONCE]) for k in range(0, len(chunks), 16 * AT_ONCE)]
        good, sizes, pairs, texts = zip(*parts)
        sizes = np.concatenate(sizes)
        self.starts = np.append(self.starts, len(self.pairs) + np.cumsum(sizes[:, 3]) - sizes[:, 3])
        self.good = np.concatenate([self.good, *good])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pairs = np.concatenate([self.pairs, *pairs])
        for some in texts:
            self.written += some
        return np.arange(first, len(self.good), dtype=np.uint32), np.ones(len(chunks), dtype=np.int64)

    def slice(self, texts: W.Texts):
        """Per text: the four sizes, the digest; and all pairs, end to end."""
        starts, ends = chunk_spans(texts)
        at, _ = self.known.place(texts.data, starts, ends)
        number = self.known.ids[at].astype(np.int64)
        bounds = np.searchsorted(starts, texts.bounds)
        sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(self.sizes[number], axis=0)])
        sizes = sums[bounds[1:]] - sums[bounds[:-1]]
        wrong = np.concatenate([[0], np.cumsum(~self.good[number])])
        wrong = np.flatnonzero(wrong[bounds[1:]] - wrong[bounds[:-1]])
        digests, numbers, edges = [], number.tolist(), bounds.tolist()
        for a, b in zip(edges, edges[1:]):
            digests.append(digest(b"".join([self.written[n] for n in numbers[a:b]])))
        pairs = self.pairs[W.ragged(self.starts[number], self.sizes[number, 3])]
        if len(wrong):
            parts = np.split(pairs, np.cumsum(sizes[:, 3])[:-1])
            for k in wrong.tolist():
                text = texts.data[texts.bounds[k] : texts.bounds[k + 1]].tobytes()
                _, (sizes[k],), parts[k], (joined,) = self.align([text])
                digests[k] = digest(joined)
            pairs = np.concatenate(parts)
        return sizes, digests, pairs


@cache
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


# Runs -----------------------------------------------------------------------


class Run:
    """Documents and records collected in a task until they fill a run."""

    def __init__(self, number: int):
        self.number, self.docs, self.sizes, self.digests, self.pairs = number, [], [], [], []
        self.links = 0

    def add(self, docs: pa.Array, sizes, digests, pairs) -> None:
        self.docs.append(docs)
        self.sizes.append(sizes)
        self.digests += digests
        self.pairs.append(pairs)
        self.links += len(pairs)

    def rows(self):
        """The documents, and per radix the sorted records and their sums per pair."""
        sizes = np.concatenate(self.sizes)
        columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sizes.T.copy()))
        ids = pa.chunked_array(self.docs, pa.int64())
        yield "documents", self.number, -1, packed(doc_id=ids, **columns, groups_sha256=self.digests)
        pairs, inverse = np.unique(np.concatenate(self.pairs), return_inverse=True)
        doc = np.repeat(np.arange(len(sizes)), sizes[:, 3])
        keys, times = np.unique(inverse * len(sizes) + doc, return_counts=True)
        pair, doc = keys // len(sizes), (keys % len(sizes)).astype(np.int32)
        times = times.astype(np.int32)
        sums = np.bincount(inverse, minlength=len(pairs))
        b, a = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        for radix in range(RADIXES):
            own = b % RADIXES == radix
            if own.any():
                rows = own[pair]
                which = pair[rows]
                yield "records", self.number, radix, packed(b=b[which], a=a[which], doc=doc[rows], times=times[rows])
                yield "sums", self.number, radix, packed(b=b[own], a=a[own], count=sums[own])


def _collect(batches, byte_path, piece_path, run_links):
    aligner = _aligner(byte_path, piece_path)
    # The number is the same when a lost task runs again.
    number = TaskContext.get().partitionId() << 32
    run = Run(number)

    def flushed():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*run.rows()), (pa.string(), pa.int64(), pa.int32(), pa.binary()))],
            names=["kind", "run", "radix", "data"],
        )

    for batch in batches:
        for texts in W.slices(batch.column(1)):
            run.add(batch.column(0).slice(texts.first, texts.count), *aligner.slice(texts))
            if run.links >= run_links:
                yield flushed()
                number += 1
                run = Run(number)
    if run.docs:
        yield flushed()


# Merging --------------------------------------------------------------------


def merged(runs: list[dict[str, np.ndarray]]):
    """B id, its A ids in order, and their counts, over all runs; B ids in order.

    A heap holds the next B id of each run; the blocks of one B id are summed together.
    """

    def blocks(k):
        b = runs[k]["b"]
        cuts = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(cuts[1:], len(b))
        return zip(b[cuts].tolist(), [k] * len(cuts), cuts.tolist(), ends.tolist())

    for b, group in groupby(heapq.merge(*map(blocks, range(len(runs)))), key=itemgetter(0)):
        parts = [(runs[k]["a"][i:j], runs[k]["count"][i:j]) for _, k, i, j in group]
        if len(parts) == 1:
            yield b, *parts[0]
            continue
        a, count = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(a, kind="stable")
        a, count = a[order], count[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        yield b, a[first], np.add.reduceat(count, first)


def _merge(group, last):
    """Sums of some runs of a radix as one; the last merge also tells each B id's highest."""
    runs = [unpacked(d.as_py()) for d in group.column("data")]
    bs, parts, counts, best = [], [], [], []
    for b, a, count in merged(runs):
        bs.append(np.full(len(a), b, dtype=np.int32))
        parts.append(a)
        counts.append(count)
        if last:
            best.append(count == count.max())
    columns = {"b": bs, "a": parts, "count": counts} | ({"best": best} if last else {})
    data = packed(**{name: np.concatenate(c) for name, c in columns.items()})
    return pa.table({"radix": group.column("radix")[:1], "run": group.column("run")[:1], "data": pa.array([data], pa.binary())})


def counted(sums: DataFrame, n_runs: int) -> DataFrame:
    """Per radix the count of every pair, and whether it is its B id's highest."""
    while n_runs > FAN:
        n_runs = -(-n_runs // FAN)
        sums = written(
            sums.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(n_runs)))
            .groupBy("radix", "run")
            .applyInArrow(in_workers(_merge, last=False), "radix int, run long, data binary"),
            "sums",
        )
    return written(
        sums.withColumn("run", F.lit(0).cast("long"))
        .groupBy("radix")
        .applyInArrow(in_workers(_merge, last=True), "radix int, run long, data binary"),
        "counts",
    )


def _contribute(group):
    """What the documents of some runs get from the pairs of one radix."""
    is_table = pc.equal(group.column("kind"), "counts")
    known = unpacked(group.filter(is_table).column("data")[0].as_py())
    keys = known["b"].astype(np.int64) << 32 | known["a"]
    runs = group.filter(pc.invert(is_table))
    out = []
    for data in runs.column("data"):
        own = unpacked(data.as_py())
        at = np.searchsorted(keys, own["b"].astype(np.int64) << 32 | own["a"])
        docs, inverse = np.unique(own["doc"], return_inverse=True)
        n_best, total = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
        np.add.at(n_best, inverse, own["times"] * known["best"][at])
        np.add.at(total, inverse, own["times"] * known["count"][at])
        out.append(packed(doc=docs, n_best=n_best, count_sum=total))
    return pa.table(
        {"kind": pa.array(["parts"] * len(out)), "run": runs.column("run"), "data": pa.array(out, pa.binary())}
    )


def _finish(group):
    """The documents of one run with what every radix gave them."""
    kinds = group.column("kind").to_pylist()
    data = group.column("data")
    docs = pa.ipc.open_stream(data[kinds.index("documents")].as_py()).read_all()
    sums = np.zeros((2, len(docs)), dtype=np.int64)
    for kind, part in zip(kinds, data):
        if kind == "parts":
            own = unpacked(part.as_py())
            sums[0, own["doc"]] += own["n_best"]
            sums[1, own["doc"]] += own["count_sum"]
    digests = docs.column("groups_sha256")
    docs = docs.drop_columns(["groups_sha256"])
    for name, values in zip(("n_best", "count_sum"), sums):
        docs = docs.append_column(name, pa.array(values))
    return docs.append_column("groups_sha256", digests)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, run_links: int = RUN_LINKS) -> DataFrame:
    """The alignment of every document, and the corpus-wide counts of its pairs.

    A task ends a run after the slice of texts that brings it to `run_links` links.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.when(text != "", F.concat(F.lit(" "), text)).alias("text"))
    folder = work_dir(spark, "runs")
    collect = in_workers(_collect, byte_path=byte_path, piece_path=piece_path, run_links=run_links)
    rows.mapInArrow(collect, RUNS).write.partitionBy("kind").parquet(folder)
    runs = spark.read.schema(RUNS).parquet(folder)

    def of(kind):
        return runs.where(F.col("kind") == kind)

    n_runs = of("documents").count()
    counts = counted(of("sums").select("radix", "run", "data"), n_runs)
    groups = max(1, -(-n_runs // RUNS_AT_ONCE))
    slot = F.pmod(F.xxhash64("run"), F.lit(groups))
    tables = counts.select(
        F.lit("counts").alias("kind"),
        "run",
        "radix",
        "data",
        F.explode(F.sequence(*(F.lit(n).cast("long") for n in (0, groups - 1)))).alias("slot"),
    )
    parts = (
        of("records")
        .withColumn("slot", slot)
        .unionByName(tables)
        .groupBy("radix", "slot")
        .applyInArrow(in_workers(_contribute), "kind string, run long, data binary")
    )
    return (
        of("documents")
        .select("kind", "run", "data")
        .unionByName(parts)
        .groupBy("run")
        .applyInArrow(in_workers(_finish), RESULT)
    )
