"""Personal data: fixed forms as seeds, and contexts learned from them for unseen forms.

E-mail and IP addresses, card and phone numbers of fixed form are the seeds. The two words
before a match are its lexical pattern. Patterns and the texts they introduce (seeds and
other identifier-like runs, or groups of them, with at least six digits) form a graph. In each round the
confidence of a pattern for a kind is the mean score of all that it introduces, and the
score of an unseen text is what its patterns together give it. Confident patterns with
enough seeds discover what else they introduce. All of it is built-in functions; scores
are tables that are joined, and no pattern or instance is collected.

Null text counts as empty and has no spans. Discovered spans never overlap seeds, and
seeds always stay. Repeated rows count once in the graph and are reported each. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.spans import FOUND, bound, clean_text, count_before, digits, free, listed, matches, number_of
from sensorflow.llm.tables import written

KINDS = ["email", "ip", "card", "phone"]
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
UNSEEN = r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9_/-]*+"
GROUPED = UNSEEN + r"(?:[\x20.][0-9][A-Za-z0-9_/-]*+)*+"
LEAST_DIGITS = 6
#: Code points of a pattern that is kept as it is; a longer one is kept as a digest.
LONG = 200


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))

    def worth(place: Column) -> Column:
        digit = F.substring(number, F.length(number) - place + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _good_ip(hit: Column) -> Column:
    # Leading zeros are cut first, so a part of any length can be compared.
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(
        F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
    )


def _good_card(hit: Column) -> Column:
    number = digits(hit)
    return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)


def seeds(text: Column) -> Column:
    """All base spans, by kind as in KINDS and then by place."""
    return F.concat(
        matches(text, 0, EMAIL, lambda hit: hit.isNotNull(), text.contains("@"), pattern_of),
        matches(text, 1, IP, _good_ip, context=pattern_of),
        matches(text, 2, CARD, _good_card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), pattern_of),
        matches(text, 3, PHONE, lambda hit: F.length(digits(hit)).between(8, 15), text.contains("+"), pattern_of),
    )


def unseen(text: Column) -> Column:
    """Identifier-like runs of no fixed form, each by itself."""
    return matches(
        text, 0, UNSEEN, lambda hit: F.length(digits(hit)) >= LEAST_DIGITS, text.rlike("[0-9]"), pattern_of
    )


def grouped(text: Column) -> Column:
    """Runs that single blanks or dots join, of two at least; digits count over all of them."""
    several = lambda hit: hit.rlike(r"[\x20.]") & (F.length(digits(hit)) >= LEAST_DIGITS)
    return matches(text, 0, GROUPED, several, text.rlike(r"[\x20.][0-9]"), pattern_of)


def candidates(base: Column, alone: Column, joined: Column) -> Column:
    """Span and place of its run of groups, apart from base spans.

    A run by itself is a candidate beside the groups it is part of, since its own context
    may be the one that is known; the first of the groups has the same context as all.
    """
    def placed(whole: Column) -> Column:
        def around(s: Column) -> Column:
            # Runs of groups don't overlap, so only the last that starts no later can hold the span.
            run = F.get(whole, count_before(whole, s["start"] + 1) - 1)
            return F.when(s["end"] <= run["end"], run["start"])

        place = lambda s: F.struct(F.coalesce(around(s), s["start"]).alias("run"), around(s).isNull().alias("single"), s.alias("s"))
        parts = F.filter(
            F.transform(free(alone, base, len(KINDS)), place), lambda p: (p["run"] < p["s"]["start"]) | p["single"]
        )
        return F.concat(
            F.transform(whole, lambda s: F.struct(s["start"].alias("run"), s.alias("s"))),
            F.transform(parts, lambda p: F.struct(p["run"].alias("run"), p["s"].alias("s"))),
        )

    return bound(free(joined, base, len(KINDS)), placed)


def pattern_of(before: Column) -> Column:
    """The last two words before a span, in lower case and with digits masked; else empty.

    `before` has single blanks. Words beyond LONG stand as their digest, so that a text
    without blanks does not hold its own beginning once for every match.
    """
    words = F.substring_index(F.rtrim(before), " ", -2)
    masked = F.regexp_replace(F.lower(words), "[0-9]+", "0")
    whole = F.when(F.length(masked) > LONG, F.sha2(masked, 256)).otherwise(masked)
    return F.when(F.ltrim(words).contains(" "), whole).otherwise("")


def confident_patterns(
    seen: DataFrame, others: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8
) -> DataFrame:
    """pattern, kind and confidence of the patterns to trust.

    `seen` has pattern, instance and kind, `others` pattern and instance.
    """
    known = seen.select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    edges = written(
        seen.select("pattern", "instance", F.lit(True).alias("seed"))
        .unionByName(others.select("pattern", "instance", F.lit(False).alias("seed")))
        .where("pattern != ''")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed")),
        "pattern_graph",
    )
    sizes = written(
        edges.groupBy("pattern").agg(F.count("*").alias("size"), F.count_if("seed").alias("seeds")), "patterns"
    ).where(F.col("seeds") >= least_seeds)
    scores, found = written(known, "instance_scores"), None
    for _ in range(rounds):
        found = written(
            edges.join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("mass"))
            .join(sizes, "pattern")
            .select("pattern", "kind", (F.col("mass") / F.col("size")).alias("confidence")),
            "pattern_scores",
        )
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        fresh = (
            edges.where("NOT seed")
            .join(found, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(doubt))).alias("score"))
        )
        scores = written(known.unionByName(fresh), "instance_scores")
    return found.where(F.col("confidence") >= confidence)


def find(docs: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """doc_id, base spans and added spans (arrays of kind, start, end, hit) of every document."""
    text = clean_text(F.col("text"))
    found = written(
        docs.select(F.col("doc_id").cast("long"), text.alias("text"))
        .select(
            "doc_id",
            seeds(F.col("text")).alias("base"),
            unseen(F.col("text")).alias("alone"),
            grouped(F.col("text")).alias("joined"),
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "personal",
    )
    seen = found.select(F.explode("base").alias("s")).select(
        F.col("s.before").alias("pattern"), F.col("s.hit").alias("instance"), "s.kind"
    )
    places = written(
        found.select("row", F.explode(candidates(F.col("base"), F.col("alone"), F.col("joined"))).alias("c"))
        .select("row", "c.run", "c.s")
        .select("row", "run", F.col("s.before").alias("pattern"), F.col("s.hit").alias("instance"), "s"),
        "unseen",
    )
    trusted = confident_patterns(seen, places, rounds, least_seeds, confidence)
    best = trusted.groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("minus"))).alias("best"))
    added = (
        places.join(best.select("pattern", (-F.col("best.minus")).alias("kind")), "pattern")
        .select("row", "run", F.col("s").withField("kind", F.col("kind")).alias("s"))
        .groupBy("row", "run")
        .agg(F.collect_list("s").alias("parts"))
        # All groups of a run, if found, stand for the parts found in it.
        .withColumn("all", F.filter("parts", lambda s: (s["start"] == F.col("run")) & s["hit"].rlike(r"[\x20.]")))
        .groupBy("row")
        .agg(F.flatten(F.collect_list(F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("parts")))).alias("added"))
    )
    return found.join(added, "row", "left").select(
        "doc_id",
        "base",
        F.coalesce("added", F.array().cast(FOUND)).alias("added"),
    )


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base spans, and all spans as text."""
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *(number_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(every, KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
