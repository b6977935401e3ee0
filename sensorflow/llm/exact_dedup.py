"""Exact dedup: groups by a 128-bit content hash, with bytes compared inside groups.

Two texts are equal when they are the same after white space is deleted. Documents are
grouped by the MD5 of that form. Inside each group of several rows the least and the
greatest text are found; a large group is cut into parts for that, so it never meets in
one task. If they differ, the hash collided, and that group alone is split by its texts.

Of equal texts the row with the most code points stays, then the smallest doc_id, then
any one of rows that tie in both. Null counts as empty text; empty texts are equal. A
null doc_id ranks last. An empty table gives an empty result. Other columns are kept by
`kept_documents` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.tables import written

LAST_ID = 2**63 - 1
# Rows of a group that are compared in one part, and how many larger groups there can be.
PART_ROWS = 10_000
MOST_HOT = 100_000


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_hash(normal: Column) -> Column:
    return F.unhex(F.md5(normal.cast("binary")))


def collisions(docs: DataFrame, hashed: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    """Hashes whose groups hold different texts; as a rule none.

    The texts of a large group are compared in parts, by the least and the greatest of
    each, and then those of the parts. Groups above a MOST_HOT-th of all rows are large, so
    there are fewer than MOST_HOT of them, and their hashes can be broadcast.
    """
    several = written(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "several")
    part_rows = max(PART_ROWS, -(-hashed.count() // MOST_HOT))
    parts = F.ceil(F.col("n") / part_rows)
    hot = several.where(F.col("n") > part_rows).select("h", parts.alias("parts"))
    texts = (
        docs.select(F.monotonically_increasing_id().alias("id"), normal_text(F.col("text")).alias("normal"))
        .withColumn("h", hash_of(F.col("normal")))
        .join(F.broadcast(hot), "h", "left")
        .withColumn("part", F.pmod("id", F.coalesce("parts", F.lit(1))))
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    ends = (
        texts.join(several.select("h", every.alias("part")), ["h", "part"])
        .groupBy("h", "part")
        .agg(F.min("normal").alias("a"), F.max("normal").alias("z"))
        .groupBy("h")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"))
    )
    return written(ends.where("a != z").select("h"), "collisions")


def classes(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Per row: doc_id, n_chars, h, twin (tells colliding texts apart), text_sha256, row."""
    own = docs.select(
        F.col("doc_id").cast("long"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        normal_text(F.col("text")).alias("normal"),
    ).withColumn("h", hash_of(F.col("normal")))
    digest = F.sha2(F.col("normal").cast("binary"), 256)
    hashed = written(own.select("doc_id", "n_chars", "h", digest.alias("text_sha256")), "hashed")
    clash = collisions(docs, hashed, hash_of)
    if clash.isEmpty():
        found = hashed.withColumn("twin", F.lit(""))
    else:
        mixed = own.join(clash.withColumn("clash", F.lit(True)), "h", "left").select(
            "doc_id",
            "n_chars",
            "h",
            digest.alias("text_sha256"),
            F.when(F.col("clash"), F.col("normal")).otherwise("").alias("twin"),
        )
        found = mixed
    # Written with a number each, so that rows alike in everything can be told apart.
    return written(found.withColumn("row", F.monotonically_increasing_id()), "classes")


def _best() -> Column:
    """Orders the rows of a class: the least stays."""
    return F.struct(
        (-F.col("n_chars")).alias("shorter"),
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("id"),
        F.col("row").alias("row"),
        F.col("doc_id").alias("doc_id"),
    )


def _groups(members: DataFrame) -> DataFrame:
    return members.groupBy("h", "twin").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size"))


def deduplicated(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    members = classes(docs, hash_of)
    groups = written(_groups(members), "groups")
    return members.join(groups, ["h", "twin"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def kept_documents(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The documents that stay, with all their columns.

    A document is recognised by its hash, id and length. Only where rows tie in all of
    these is one of them picked.
    """
    members = classes(docs, hash_of)
    best = written(_groups(members), "groups").select(
        "h", "twin", F.col("best.doc_id").alias("doc_id"), (-F.col("best.shorter")).alias("n_chars")
    )
    stay = written(
        members.join(best.withColumnRenamed("doc_id", "keep_id").withColumnRenamed("n_chars", "most"), ["h", "twin"])
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")))
        .groupBy("h", "twin", "doc_id", "n_chars")
        .agg(F.count("*").alias("ties")),
        "stay",
    ).select(
        "h",
        "twin",
        "ties",
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("id"),
        F.col("n_chars").alias("most"),
    )
    normal = normal_text(F.col("row.text"))
    rows = (
        docs.select(F.struct("*").alias("row"))
        .withColumn("h", hash_of(normal))
        .withColumn("id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID)))
        .withColumn(
            "most",
            F.char_length(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).cast("long"),
        )
        .join(stay, ["h", "id", "most"])
        .where((F.col("twin") == "") | (F.col("twin") == normal_text(F.col("row.text"))))
    )
    alone = rows.where("ties = 1").select("row.*")
    tied = rows.where("ties > 1").dropDuplicates(["h", "twin", "id", "most"]).select("row.*")
    return alone.unionByName(tied)
