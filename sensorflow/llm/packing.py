"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Each document's ids, with a closing id, are cut into pieces only if they exceed the
capacity. A full piece is a sequence by itself. The others are dealt at random to blocks
of about `block` pieces, and every block is packed by several islands. An island evolves
whole packings: crossover injects well-filled bins of one parent into the other, bins
that hold an injected piece are dissolved, and the displaced pieces are put back by best
fit. Between epochs each island's best packing moves to the next island of its block.
The best packing of each block wins; a block that has reached its lower bound stops.
Then the emptiest sequences of every block are dissolved, and their pieces meet in fewer
blocks of a next round, until one block is left or there would be no fewer.

Null and empty texts are a document of the closing id alone. Repeated rows are packed
each. A null doc_id is kept as null. Other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorflow.llm import words as W
from sensorflow.llm.chunks import Cache, per_text, ragged
from sensorflow.llm.tables import in_workers, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, uids array<long>, lengths array<int>, elites array<array<int>>"
PLACES = "uid long, sequence_id long, offset long"
ELITES = "array<array<int>>"
SEQUENCES = "loose boolean, uids array<long>, lengths array<int>"
#: A block's emptiest sequences go on to the next round up to this share of its pieces.
LOOSE = 0.125


class WordTokens:
    """Ids of words by a tokenizer that drops white space, so words stand alone."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Cache(self.encode_words)

    def encode_words(self, words: list[bytes], joined: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the tokenizer in lines of many; offsets tell whose each id is."""
        ids, lengths = [], np.zeros(len(words), dtype=np.int64)
        texts = [w.decode("utf-8") for w in words]
        for at in range(0, len(texts), joined):
            some = texts[at : at + joined]
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            if found.ids:
                begins = np.cumsum([0] + [len(t) + 1 for t in some[:-1]])
                places = np.array(found.offsets, dtype=np.int64)[:, 0]
                owner = np.searchsorted(begins, places, side="right") - 1
                lengths[at : at + len(some)] += np.bincount(owner, minlength=len(some))
                ids.append(np.array(found.ids, dtype=np.uint32))
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32), lengths


@cache
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _cut(batches, path, capacity, closing):
    known = _tokens(path).known
    for batch in batches:
        row = 0
        for texts in W.slices(batch.column(1)):
            starts, ends = W.words(texts)
            at, lengths = known.place(texts.data, starts, ends)
            sizes = per_text(texts, starts, lengths)
            ids = known.ids[ragged(at, lengths)].astype("<u4")
            docs, pieces, begins, counts, sums = [], [], [], [], []
            end = 0
            for k, size in enumerate(sizes.tolist()):
                own = np.append(ids[end : end + size], np.array(closing, dtype="<u4"))
                end += size
                for n, begin in enumerate(range(0, size + 1, capacity)):
                    part = own[begin : begin + capacity]
                    docs.append(row + k)
                    pieces.append(n)
                    begins.append(begin)
                    counts.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
            row += texts.count
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(docs, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    *(pa.array(c, pa.int64()) for c in (begins, counts, sums)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def cut(docs: DataFrame, path: str, capacity: int, closing: int = 0) -> DataFrame:
    """The pieces of every document, with a CRC-32 of their ids."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(in_workers(_cut, path=path, capacity=capacity, closing=closing), PIECES)


# One block ------------------------------------------------------------------


class Bins:
    """A packing that grows by best fit: free space per bin, and bins by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.members = capacity, [], []
        self.by_free: list[tuple[int, int]] = []

    def add_bin(self, items: list[int], used: int) -> None:
        self.members.append(list(items))
        self.free.append(self.capacity - used)
        insort(self.by_free, (self.capacity - used, len(self.free) - 1))

    def best_fit(self, item: int, length: int) -> None:
        at = bisect_left(self.by_free, (length, -1))
        if at == len(self.by_free):
            self.add_bin([item], length)
            return
        free, k = self.by_free.pop(at)
        self.members[k].append(item)
        self.free[k] = free - length
        insort(self.by_free, (free - length, k))


Packing = list[list[int]]


def fitted(lengths: list[int], order: list[int], capacity: int, bins: Packing = ()) -> Packing:
    """The given bins with the items of `order` added by best fit."""
    packing = Bins(capacity)
    for members in bins:
        packing.add_bin(members, sum(lengths[i] for i in members))
    for i in order:
        packing.best_fit(i, lengths[i])
    return packing.members


def cost(lengths: list[int], packing: Packing, capacity: int) -> tuple[int, float]:
    """Bins, then how evenly filled they are; full and empty beats half and half."""
    fill = sum((sum(lengths[i] for i in members) / capacity) ** 2 for members in packing)
    return len(packing), -fill


def crossover(lengths, one: Packing, other: Packing, capacity: int, rng: random.Random) -> Packing:
    """Well-filled bins of `other` go whole into `one`; what they displace is refitted."""
    fill = {k: sum(lengths[i] for i in members) for k, members in enumerate(other)}
    full = sorted(fill, key=fill.get, reverse=True)[: max(1, len(other) // 2)]
    injected = [other[k] for k in full if rng.random() < 0.5] or [other[full[0]]]
    taken = {i for members in injected for i in members}
    kept, displaced = [], []
    for members in one:
        if taken.isdisjoint(members):
            kept.append(members)
        else:
            displaced += [i for i in members if i not in taken]
    return fitted(lengths, _falling(lengths, displaced), capacity, injected + kept)


def mutated(lengths, packing: Packing, capacity: int, rng: random.Random) -> Packing:
    """The emptiest bins and a few others are dissolved and refitted."""
    order = sorted(range(len(packing)), key=lambda k: sum(lengths[i] for i in packing[k]))
    gone = set(order[:2]) | {rng.randrange(len(packing)) for _ in range(3)}
    loose = [i for k in gone for i in packing[k]]
    return fitted(
        lengths, _falling(lengths, loose), capacity, [m for k, m in enumerate(packing) if k not in gone]
    )


def _falling(lengths: list[int], items: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -lengths[i])


def lower_bound(lengths: list[int], capacity: int) -> int:
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def evolved(lengths, elites: list[Packing], capacity: int, seed, population: int, generations: int):
    """The island's packings, best first."""
    rng = random.Random(seed)
    bound = lower_bound(lengths, capacity)
    score = lambda p: cost(lengths, p, capacity)
    alive = sorted(elites, key=score)
    if not alive:
        alive = [fitted(lengths, _falling(lengths, list(range(len(lengths)))), capacity)]
    while len(alive) < population and len(alive[0]) > bound:
        noisy = [n * (0.8 + 0.4 * rng.random()) for n in lengths]
        order = sorted(range(len(lengths)), key=lambda i: -noisy[i])
        alive = sorted([*alive, fitted(lengths, order, capacity)], key=score)
    for _ in range(generations):
        if len(alive[0]) <= bound:
            break
        children = [
            crossover(lengths, *rng.sample(alive, 2), capacity, rng),
            mutated(lengths, alive[0], capacity, rng),
        ]
        alive = sorted([*alive, *children], key=score)[:population]
    return alive


def _evolve(batches, capacity, epoch, population, generations, elite):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            lengths = row["lengths"]
            packings = [_packing(bins) for bins in row["elites"]]
            if packings and epoch == 0:
                order = _falling(lengths, list(range(len(lengths))))
                packings.append(fitted(lengths, order, capacity))
            seed = f"{row['block']}-{row['island']}-{epoch}"
            found = evolved(lengths, packings, capacity, seed, population, generations)
            out.append(row | {"elites": [_numbers(p, len(lengths)) for p in found[:elite]]})
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def _packing(bins: list[int]) -> Packing:
    packing: Packing = [[] for _ in range(max(bins, default=-1) + 1)]
    for i, k in enumerate(bins):
        packing[k].append(i)
    return [members for members in packing if members]


def _numbers(packing: Packing, n: int) -> list[int]:
    bins = [0] * n
    for k, members in enumerate(packing):
        for i in members:
            bins[i] = k
    return bins


def _sequences(batches, last):
    """The sequences of each block; loose ones are to meet those of other blocks."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            uids, lengths = row["uids"], row["lengths"]
            left = 0 if last else max(1, int(LOOSE * len(uids)))
            loose = not last
            for members in sorted(_packing(row["bins"]), key=lambda m: (sum(lengths[i] for i in m), m)):
                loose, left = loose and left > 0, left - len(members)
                out.append((loose, [uids[i] for i in members], [lengths[i] for i in members]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(c, t)
                for c, t in zip(
                    zip(*out) if out else [[], [], []], (pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                )
            ],
            names=["loose", "uids", "lengths"],
        )


def _place(batches):
    """Each item's sequence, named by the uid of its first piece, and its offset there."""
    for batch in batches:
        uids, names, offsets = [], [], []
        for row in batch.to_pylist():
            at = 0
            for uid, length in zip(row["uids"], row["lengths"]):
                uids.append(uid)
                names.append(row["uids"][0])
                offsets.append(at)
                at += length
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (uids, names, offsets)],
            names=["uid", "sequence_id", "offset"],
        )


# All blocks -----------------------------------------------------------------


def placed(
    pieces: DataFrame,
    capacity: int,
    block: int = 2000,
    islands: int = 3,
    epochs: int = 2,
    population: int = 6,
    generations: int = 12,
    elite: int = 2,
) -> DataFrame:
    """uid, sequence_id and offset of every piece shorter than the capacity.

    `pieces` has uid and length. Blocks are dealt by a hash of the uid, so their sizes
    stay near `block` whatever the data hold.
    """
    blocks = max(1, -(-pieces.count() // block))
    members = F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length"))))
    state = (
        pieces.groupBy(_dealt("uid", blocks))
        .agg(members.alias("m"))
        .select("block", F.col("m.uid").alias("uids"), F.col("m.length").alias("lengths"), F.array().cast(ELITES).alias("elites"))
    )
    done, turn = [], 0
    while True:
        best = _best(state, capacity, islands, epochs, population, generations, elite, turn)
        found = written(best.mapInArrow(in_workers(_sequences, last=blocks == 1), SEQUENCES), f"sequences_{turn}")
        done.append(found.where("NOT loose"))
        if blocks == 1:
            break
        loose, before = found.where("loose"), blocks
        blocks = max(1, -(-(loose.agg(F.sum(F.size("uids"))).first()[0] or 0) // block))
        if blocks >= before:
            done.append(loose)
            break
        # Sequences are dealt whole and begin as they are, so that a round never adds one.
        members = F.sort_array(F.collect_list(F.struct("uids", "lengths")))
        bins = F.flatten(F.transform("m", lambda s, k: F.array_repeat(k, F.size(s["uids"]))))
        state = (
            loose.groupBy(_dealt("uids", blocks))
            .agg(members.alias("m"))
            .select(
                "block",
                F.flatten("m.uids").alias("uids"),
                F.flatten("m.lengths").alias("lengths"),
                F.array(bins).cast(ELITES).alias("elites"),
            )
        )
        turn += 1
    return reduce(DataFrame.unionByName, done).mapInArrow(in_workers(_place), PLACES)


def _dealt(by: str, blocks: int):
    return F.pmod(F.xxhash64(by), F.lit(blocks)).alias("block")


def _best(state, capacity, islands, epochs, population, generations, elite, turn) -> DataFrame:
    """uids, lengths and bins of the best packing of each block."""
    state = state.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uids", "lengths", "elites"
    )
    for epoch in range(epochs):
        evolve = in_workers(
            _evolve, capacity=capacity, epoch=epoch, population=population, generations=generations, elite=elite
        )
        spread = state.repartition(F.col("block"), F.col("island"))
        state = written(spread.mapInArrow(evolve, STATE), f"islands_{turn}_{epoch}")
        if epoch + 1 < epochs:
            guests = state.select(
                "block",
                ((F.col("island") + 1) % islands).cast("int").alias("island"),
                F.slice("elites", 1, 1).alias("guest"),
            )
            state = state.join(guests, ["block", "island"]).select(
                "block", "island", "uids", "lengths", F.concat("elites", "guest").alias("elites")
            )
    best = F.min_by(F.struct("uids", "lengths", F.col("elites")[0].alias("bins")), _rank()).alias("b")
    return state.groupBy("block").agg(best).select("b.*")


def _rank():
    """Bins of an island's best packing, then the island, so ties have one winner."""
    return F.struct(F.array_max(F.col("elites")[0]), F.col("island"))


def packed(docs: DataFrame, path: str, capacity: int, closing: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(
        cut(docs, path, capacity, closing).withColumn("uid", F.monotonically_increasing_id()), "pieces"
    )
    short = pieces.where(F.col("length") < capacity)
    full = pieces.where(F.col("length") >= capacity).select(
        "*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    places = placed(short.select("uid", "length"), capacity)
    return short.join(places, "uid").unionByName(full).drop("uid")
