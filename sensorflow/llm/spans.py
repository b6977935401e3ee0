"""Matches of patterns with their places, as columns of built-in functions.

A text split at the matches of a pattern gives the gaps between them, so running sums of
gap and match lengths are the places, in code points. Patterns are possessive and start
only where a run can start, which keeps matching linear and free of recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<kind:int,start:int,end:int,hit:string,before:string>>"
BLANKS = r"[\x20\x09-\x0D]+"


def clean_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def matches(
    text: Column,
    kind: int,
    pattern: str,
    keep: Callable[[Column], Column],
    possible: Column | None = None,
    context: Callable[[Column], Column] | None = None,
) -> Column:
    """The leftmost non-overlapping matches that `keep` accepts, in order.

    A match that is not accepted is dropped; nothing inside it is tried again. `possible`
    is a cheaper condition that holds wherever the pattern matches. `before` is what
    `context` makes of the end of the text before a match: two whole words at least, if
    there are so many, with runs of blanks as one. Without `context` it is empty. The
    words are carried from match to match, so that a text is read once.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def last_words(words: Column, *pieces: Column) -> Column:
        return F.substring_index(F.concat(words, *pieces), " ", -3) if context else F.lit("")

    def after(words: Column, pair: Column) -> Column:
        # The last gap has no match after it.
        blank = lambda c: F.coalesce(F.regexp_replace(c, BLANKS, " "), F.lit(""))
        return last_words(words, blank(pair["gap"]), blank(pair["hit"]))

    def long(pair: Column) -> Column:
        return F.length(pair["gap"]) + F.coalesce(F.length(pair["hit"]), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        gap = F.regexp_replace(pair["gap"], BLANKS, " ")
        one = F.struct(
            F.lit(kind).alias("kind"),
            begin.alias("start"),
            (begin + F.length(pair["hit"])).alias("end"),
            pair["hit"].alias("hit"),
            (context(last_words(state["words"], gap)) if context else F.lit("")).alias("before"),
        )
        found = F.when(keep(pair["hit"]), F.concat(state["found"], F.array(one))).otherwise(state["found"])
        return F.struct(
            (state["at"] + long(pair)).alias("at"), after(state["words"], pair).alias("words"), found.alias("found")
        )

    def block_found(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), block["words"].alias("words"), F.array().cast(FOUND).alias("found"))
        return F.aggregate(block["pairs"], start, step, lambda state: state["found"])

    def next_begin(begins: Column, block: Column) -> Column:
        """Where each block begins, one more than there are: place, and the words before it."""
        last = F.element_at(begins, -1)
        at = last["at"] + F.aggregate(block, F.lit(0), lambda n, pair: n + long(pair))
        words = last_words(last["words"], F.aggregate(block, F.lit(""), after)) if context else F.lit("")
        return F.concat(begins, F.array(F.struct(at.alias("at"), words.alias("words"))))

    def located(blocks: Column) -> Column:
        first = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("words")))
        begins = F.when(F.size(blocks) > 1, F.aggregate(blocks, first, next_begin)).otherwise(first)
        placed = F.zip_with(
            blocks,
            begins,
            lambda block, begin: F.struct(begin["at"].alias("at"), begin["words"].alias("words"), block.alias("pairs")),
        )
        return F.flatten(F.transform(F.filter(placed, lambda p: p["pairs"].isNotNull()), block_found))

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    all_found = bound(pairs, lambda p: bound(in_blocks(p), located))
    return F.when(text.rlike(pattern) if possible is None else possible, all_found).otherwise(
        F.array().cast(FOUND)
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(items: Column, least: int = 64) -> Column:
    """An array cut into about as many parts as each has items.

    An array that grows is copied with every step, so work on parts is the power 1.5 of the
    size and not its square.
    """
    size = F.greatest(F.lit(least), F.ceil(F.sqrt(F.size(items))).cast("int"))
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), n)
    return bound(size, lambda n: F.transform(starts(n), lambda i: F.slice(items, i, n)))


def listed(found: Column, names: list[str]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def number_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def count_before(spans: Column, limit: Column) -> Column:
    """How many of some spans, in order of their starts, start before a place; by binary search."""
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int") + 1)

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less = F.get(spans, middle)["start"] < limit
        low = F.when(less, middle + 1).otherwise(at["low"])
        high = F.when(less, at["high"]).otherwise(middle)
        return F.when(at["low"] < at["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(at)

    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.aggregate(halvings, start, halve)["low"]


def free(found: Column, base: Column, kinds: int) -> Column:
    """The found spans that overlap none of the base spans, which are in order by kind.

    Spans of one kind don't overlap each other, so of those that start before a span ends
    the last one decides.
    """

    def of(kind: int) -> Column:
        return F.filter(base, lambda b: b["kind"] == kind)

    def met(own: Column, s: Column) -> Column:
        last = F.get(own, count_before(own, s["end"]) - 1)
        return F.coalesce(last["end"] > s["start"], F.lit(False))

    def alone(lists: Column) -> Column:
        return F.filter(found, lambda s: ~F.exists(lists, lambda own: met(own, s)))

    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(bound(F.array(*map(of, range(kinds))), alone))
