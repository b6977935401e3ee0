"""Exact top-k search by inner product, on vectors of whole numbers sorted by length.

Candidates are dealt into classes of falling length, large classes into salted slabs. A
query first meets the longest few candidates, which gives a floor for its k-th score. By
Cauchy and Schwarz it then needs only the classes whose greatest length, times its own,
reaches that floor. Inside a slab blocks go by falling length; the leading directions of an
SVD give partial sums, and what the other directions could add is bounded by the product
of the lengths left over. Only pairs whose bound reaches the floor, which rises on the
way, are multiplied out in whole numbers.

Vectors that are null, hold null or non-finite components, components beyond 2**62 after
scaling, or no id take no part. Shorter vectors count as padded with zeros. Scores are
sums of longs. Ties go to the smaller id. Rows that repeat are candidates each, and each
row of a query answers for itself; candidates with the query's own id are left out. An
empty table gives no rows. Other columns are not read.

Bounds, for memory and not for results: the SVD is fitted to at most FIT_VALUES components,
floors to at most HEAD_VALUES of the longest candidates; both go through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.llm.tables import in_workers, written

FIT_VALUES = 1 << 20
HEAD_VALUES = 1 << 17
SLAB_VALUES = 1 << 21
QUERY_VALUES = 1 << 20
CLASSES = 64
BLOCK = 512
ROUNDING = 1e-9
RESULT = "query_id long, rank int, vec_id long, score long"
FOUND = "query long, query_id long, vec_id long, score long"
NOTHING = np.iinfo(np.int64).min


# One slab -------------------------------------------------------------------


class Vectors:
    """Whole vectors, their lengths, and their parts along some directions."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray):
        self.ids, self.x = ids, x
        self.real = x.astype(np.float64)
        square = np.einsum("ij,ij->i", self.real, self.real)
        self.length = np.sqrt(square)
        self.lead = self.real @ axes
        self.rest = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", self.lead, self.lead), 0))

    def take(self, rows) -> "Vectors":
        out = object.__new__(Vectors)
        for name, values in vars(self).items():
            setattr(out, name, values[rows])
        return out


def products(queries: Vectors, others: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of the pairs, in whole numbers."""
    small = queries.length.max(initial=0) * others.length.max(initial=0) < 2**52
    if small and 4 * len(i) > len(queries.ids) * len(others.ids):
        return np.rint((queries.real @ others.real.T)[i, j]).astype(np.int64)
    out = np.empty(len(i), dtype=np.int64)
    step = max(1, (1 << 20) // max(1, queries.x.shape[1]))
    for k in range(0, len(i), step):
        a, b = queries.x[i[k : k + step]], others.x[j[k : k + step]]
        out[k : k + step] = np.einsum("ij,ij->i", a, b)
    return out


def best(queries: Vectors, floor: np.ndarray, others: Vectors, k: int):
    """Query row, candidate id and score of each query's k best, none below its floor.

    `floor` is a score that at least k candidates of the whole table reach, or NOTHING.
    """
    others = others.take(np.argsort(-others.length, kind="stable"))
    kept = [np.zeros(0, dtype=np.int64)] * 3
    parts = [kept]
    for a in range(0, len(queries.ids), BLOCK):
        parts.append(_best(queries.take(slice(a, a + BLOCK)), floor[a : a + BLOCK].copy(), others, k, a))
    return [np.concatenate(p) for p in zip(*parts)]


def _best(queries, floor, others, k, first):
    rows, ids, scores = (np.zeros(0, dtype=np.int64) for _ in range(3))
    live = np.arange(len(queries.ids))
    for b in range(0, len(others.ids), BLOCK):
        block = others.take(slice(b, b + BLOCK))
        # Lengths fall, so a query out of reach of this block is out of reach of all to come.
        reach = queries.length[live] * block.length[0] * (1 + ROUNDING) + ROUNDING
        live = live[reach >= floor[live]]
        if not len(live):
            break
        own = queries.take(live)
        bound = own.lead @ block.lead.T + np.outer(own.rest, block.rest)
        slack = ROUNDING * (np.outer(own.length, block.length) + 1)
        i, j = np.nonzero((bound + slack >= floor[live][:, None]) & (own.ids[:, None] != block.ids[None, :]))
        score = products(own, block, i, j)
        good = score >= floor[live][i]
        i, j, score = live[i[good]], j[good], score[good]
        rows, ids, scores = np.append(rows, i), np.append(ids, block.ids[j]), np.append(scores, score)
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.searchsorted(rows, np.arange(len(queries.ids)))
        place = np.arange(len(rows)) - starts[rows]
        last = place == k - 1
        floor[rows[last]] = np.maximum(floor[rows[last]], scores[last])
        stay = place < k
        rows, ids, scores = rows[stay], ids[stay], scores[stay]
    return rows + first, ids, scores


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(values) == len(lengths) * width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


# Tasks ----------------------------------------------------------------------


def _floors(batches, axes, head, head_ids, k):
    others = Vectors(head_ids, head, axes)
    for batch in batches:
        queries = Vectors(batch.column(1).to_numpy(), _matrix(batch.column(2), axes.shape[0]), axes)
        floor = np.full(len(queries.ids), NOTHING)
        rows, _, scores = best(queries, floor, others, k)
        starts = np.searchsorted(rows, np.arange(len(floor) + 1))
        full = np.diff(starts) >= k
        floor[full] = scores[starts[1:][full] - 1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(floor)], names=["query", "vec_id", "x", "length", "floor"]
        )


def _search(group, axes, k):
    is_query = group.column("query").is_valid().to_numpy()

    def vectors(rows):
        some = group.filter(pa.array(rows))
        return some, Vectors(some.column("vec_id").to_numpy(), _matrix(some.column("x"), axes.shape[0]), axes)

    asked, queries = vectors(is_query)
    _, others = vectors(~is_query)
    rows, ids, scores = best(queries, asked.column("floor").to_numpy(), others, k)
    return pa.table(
        {
            "query": asked.column("query").take(pa.array(rows)),
            "query_id": pa.array(queries.ids[rows], pa.int64()),
            "vec_id": pa.array(ids, pa.int64()),
            "score": pa.array(scores, pa.int64()),
        }
    )


# Tables ---------------------------------------------------------------------


def whole(vectors: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id, x as longs and its length, of all rows that take part."""
    numbers = F.transform(F.col(column).cast("array<double>"), lambda v: F.lit(float(scale)) * v)
    fits = F.coalesce(F.forall("scaled", lambda v: v.isNotNull() & (F.abs(v) <= 2.0**62)), F.lit(False))
    square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("scaled"))
        .where(fits & F.col("vec_id").isNotNull())
        .select("vec_id", F.transform("scaled", lambda v: F.floor(v)).alias("x"))
        .withColumn("length", F.sqrt(square))
    )


def _axes(points: DataFrame, width: int) -> np.ndarray:
    """The leading directions of some rows, chosen by a hash of the id."""
    some = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, FIT_VALUES // width)).select("x")
    x = _matrix(some.toArrow().column("x"), width).astype(np.float64)
    x /= max(1.0, np.abs(x).max(initial=0))
    _, _, directions = np.linalg.svd(x.T @ x)
    return np.ascontiguousarray(directions[: max(1, width // 4)].T)


def top_k(vectors: DataFrame, k: int, is_query: Column, scale: int = 64, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of each row that is a query."""
    spark, points = vectors.sparkSession, written(whole(vectors, scale, column), "points")
    n, width, n_queries = points.agg(
        F.count("*"), F.max(F.size("x")), F.count_if(is_query)
    ).first()
    width = max(1, width or 1)
    axes = _axes(points, width) if n else np.ones((1, 1))
    longest = points.orderBy(F.desc("length"), "vec_id").limit(max(2 * k, HEAD_VALUES // width)).toArrow()
    head = _matrix(longest.column("x"), width)
    head_ids = longest.column("vec_id").to_numpy()

    queries = points.where(is_query).select(F.monotonically_increasing_id().alias("query"), "vec_id", "x", "length")
    queries = written(
        queries.mapInArrow(
            in_workers(_floors, axes=axes, head=head, head_ids=head_ids, k=k),
            "query long, vec_id long, x array<long>, length double, floor long",
        ),
        "floors",
    )

    slab = max(1, SLAB_VALUES // width)
    classes = min(CLASSES, -(-n // slab)) or 1
    cuts = points.agg(F.percentile_approx("length", [i / classes for i in range(1, classes)], 10_000)).first()[0] if classes > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    above = sum((F.when(F.col("length") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    points = points.withColumn("class", above)
    sizes = {
        r["class"]: (-(-r["n"] // slab), r["top"])
        for r in points.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()
    }
    if not sizes or not n_queries:
        return spark.createDataFrame([], RESULT)
    # The classes that a query reaches, and of each class how many queries reach it: what
    # nothing reaches is left out, and a slab is copied only for parts of those that do.
    reached = F.filter(
        F.array(*(F.struct(F.lit(c).alias("class"), F.lit(s).alias("salts"), F.lit(t).alias("top")) for c, (s, t) in sizes.items())),
        lambda c: c["top"] * F.col("length") * (1 + ROUNDING) + ROUNDING >= F.col("floor"),
    )
    reaching = queries.withColumn("slab", F.explode(reached))
    part_rows = max(1, QUERY_VALUES // width)
    parts = {
        r["class"]: -(-r["n"] // part_rows)
        for r in reaching.groupBy(F.col("slab.class").alias("class")).agg(F.count("*").alias("n")).collect()
    }

    def by_class(values: dict[int, int], number: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), number)

    salts = by_class({c: s for c, (s, _) in sizes.items()}, F.col("class"))
    last_part = by_class(parts, F.col("class")).cast("int") - 1
    candidates = (
        points.where(F.col("class").isin(*parts))
        .withColumn("salt", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), salts))
        .select(
            "class",
            "salt",
            F.explode(F.sequence(F.lit(0), last_part)).alias("part"),
            F.lit(None).cast("long").alias("query"),
            "vec_id",
            "x",
            F.lit(None).cast("long").alias("floor"),
        )
    )
    asked = reaching.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("slab.salts").cast("int") - 1))).select(
        F.col("slab.class").alias("class"),
        F.col("salt").cast("long").alias("salt"),
        F.pmod(F.xxhash64("query"), by_class(parts, F.col("slab.class"))).cast("int").alias("part"),
        "query",
        "vec_id",
        "x",
        "floor",
    )
    found = (
        candidates.unionByName(asked)
        .groupBy("class", "salt", "part")
        .applyInArrow(in_workers(_search, axes=axes, k=k), FOUND)
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
