"""Secret scans: who holds a secret tells copied examples from live credentials.

Assigned secrets, access keys and long hexadecimal runs are candidates, and so are other
long runs that mix letters and digits. Candidates are hashed, and for each hash the
distinct owners and repositories are counted over the corpus. One that more than
`most_owners` owners or `most_repositories` repositories hold is a widely copied example;
the others look live. Runs of no fixed form are reported only if at most `most_owners`
owners hold them. All of it is built-in
functions; a secret is counted by (hash, owner, repository) first, so a common one is
folded before it meets in one task.

Null text counts as empty and has no spans. A null owner or repository is one of its own.
Base spans always stay. Repeated rows are reported each. An empty table gives an empty
result. Other columns are kept by `redacted` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.llm.spans import FOUND, bound, clean_text, free, listed, matches, number_of
from sensorflow.llm.tables import written

# Code points of a block of text.
BLOCK = 4096
KINDS = ["assign", "access", "hex", "generic"]
BASE = KINDS[:3]
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
GENERIC = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+"


def _value(hit: Column, kind: Column | int) -> Column:
    """What is secret about a match: of an assignment, the value alone."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.when(kind == 0, F.regexp_extract(hit, ASSIGN, 2)).otherwise(hit)


def base_spans(text: Column) -> Column:
    """Base spans by start, then by kind as in KINDS."""
    found = F.concat(
        matches(text, 0, ASSIGN, lambda hit: F.length(_value(hit, 0)) >= 8),
        matches(text, 1, ACCESS, lambda hit: F.length(hit) >= 16, text.contains("AKIA")),
        matches(text, 2, HEX, lambda hit: hit.isNotNull()),
    )
    return by_place(found)


def by_place(found: Column) -> Column:
    turned = F.array_sort(
        F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"], s["hit"], s["before"]))
    )
    return F.transform(
        turned,
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["hit"].alias("hit"),
            s["before"].alias("before"),
        ),
    ).cast(FOUND)


def generic_spans(text: Column, base: Column) -> Column:
    """Long runs that mix letters and digits, outside the base spans."""
    mixed = lambda hit: (
        hit.rlike("[0-9][^0-9]+[0-9]") & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 10)
    )
    return bound(matches(text, 3, GENERIC, mixed), lambda found: free(found, base, len(BASE)))


def _with_spans(rows: DataFrame) -> DataFrame:
    return rows.withColumn("base", base_spans(F.col("text"))).withColumn(
        "generic", generic_spans(F.col("text"), F.col("base"))
    )


def _judged(found: DataFrame, most_owners: int, most_repositories: int) -> DataFrame:
    """row, s, live and repositories of every span to report.

    `found` has row, owner, repository, base and generic.
    """
    spans = found.select("row", "owner", "repository", F.explode(F.concat("base", "generic")).alias("s")).withColumn(
        "hash", F.unhex(F.sha2(_value(F.col("s.hit"), F.col("s.kind")), 256))
    )
    spans = written(spans, "secret_spans")
    holders = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    # Null counts as one more owner or repository.
    distinct = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    ownership = written(
        holders.groupBy("hash").agg(distinct("owner").alias("owners"), distinct("repository").alias("repositories")),
        "ownership",
    )
    judged = spans.join(ownership, "hash").where((F.col("s.kind") < 3) | (F.col("owners") <= most_owners))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    return judged.select("row", "s", live.alias("live"), "repositories")


def find(
    docs: DataFrame, owner: Column, repository: Column, most_owners: int = 2, most_repositories: int = 3
) -> DataFrame:
    """doc_id, base and added spans, how many spans look live or like examples, and the
    number of repositories that hold the document's most copied span (0 without one)."""
    found = _with_spans(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            clean_text(F.col("text")).alias("text"),
            owner.cast("string").alias("owner"),
            repository.cast("string").alias("repository"),
        )
    ).drop("text")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    judged = _judged(found.where("size(base) + size(generic) > 0"), most_owners, most_repositories)
    judged = judged.groupBy("row").agg(F.collect_list(F.struct("s", "live", "repositories")).alias("judged"))
    spans = F.transform("judged", lambda j: j["s"])
    return found.join(judged, "row", "left").select(
        "doc_id",
        "base",
        F.coalesce(F.filter(spans, lambda s: s["kind"] == 3), F.array().cast(FOUND)).alias("added"),
        F.coalesce(F.size(F.filter("judged", lambda j: j["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("judged", lambda j: ~j["live"])), F.lit(0)).cast("long").alias("n_example"),
        F.coalesce(F.array_max(F.transform("judged", lambda j: j["repositories"])), F.lit(0)).cast("long").alias("repositories"),
    )


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base spans, all spans as text, and the verdicts."""
    return found.select(
        "doc_id",
        *(number_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(by_place(F.concat("base", "added")), KINDS).alias("spans"),
        "n_live",
        "n_example",
        "repositories",
    )


def redacted(
    docs: DataFrame, owner: str, repository: Column, most_owners: int = 2, most_repositories: int = 3
) -> DataFrame:
    """The documents with every reported span replaced, and n_chars set anew.

    Live-looking secrets become [SECRET], widely copied ones [EXAMPLE]; overlapping spans
    become one, live if any of them is. Only documents with spans leave their place.
    """
    rows = _with_spans(
        docs.select(
            F.struct("*").alias("doc"),
            clean_text(F.col("text")).alias("text"),
            F.col(owner).cast("string").alias("owner"),
            repository.cast("string").alias("repository"),
        )
    )
    has_spans = F.size("base") + F.size("generic") > 0
    touched = written(rows.where(has_spans).withColumn("row", F.monotonically_increasing_id()), "touched")
    judged = _judged(touched.select("row", "owner", "repository", "base", "generic"), most_owners, most_repositories)
    cut = _joined(judged.select("row", "s.start", "s.end", "live"))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("cut")))
    changed = (
        touched.join(cut, "row", "left")
        .withColumn("new_text", text)
        .select(
            F.col("doc")
            .withField("text", F.col("new_text"))
            .withField("n_chars", F.length("new_text").cast("long"))
            .alias("doc")
        )
        .select("doc.*")
    )
    return rows.where(~has_spans).select("doc.*").unionByName(changed)


def _joined(spans: DataFrame) -> DataFrame:
    """row and cut: the spans of a row in order, those that overlap as one."""
    order = Window.partitionBy("row").orderBy("start", "end")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (covered.isNull() | (F.col("start") >= covered)).cast("int")
    number = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = (
        spans.withColumn("begins", begins)
        .withColumn("number", number)
        .groupBy("row", "number")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("live").alias("live"))
    )
    return whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "live"))).alias("cut"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with marks in place of the spans, which are in order and don't overlap.

    Pieces are taken out of blocks of the text, so that a place far behind is not counted
    out from the beginning.
    """
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        inside = lambda n: F.coalesce(F.get(blocks, n), F.lit(""))
        whole = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.substring(inside(first), start % BLOCK + 1, end - start)).otherwise(
            F.concat(F.substring(inside(first), start % BLOCK + 1, F.lit(BLOCK)), whole, F.substring(inside(last), F.lit(1), end % BLOCK))
        )

    def marked(state: Column) -> Column:
        blocks, ends = state["blocks"], state["ends"]
        mark = lambda s: F.when(s["live"], "[SECRET]").otherwise("[EXAMPLE]")
        pieces = F.transform(spans, lambda s, i: F.concat(piece(blocks, F.get(ends, i), s["start"]), mark(s)))
        rest = piece(blocks, F.element_at(ends, -1), F.length(text))
        return F.array_join(F.concat(pieces, F.array(rest)), "")

    return bound(F.struct(blocks.alias("blocks"), ends.alias("ends")), marked)
