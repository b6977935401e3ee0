"""URL filters: rules by host and path, else naive Bayes on segmented words.

Host labels are split into words by a unigram model: words are counted over the text of
all pages, every piece of every distinct label meets its count in a join, and Viterbi
picks the likeliest split of each label. Pages that a rule judges train a multinomial
naive Bayes on host words and path tokens, all of them, by counts; it judges the others.

A null url, or one without `://`, has an empty host and path; no rule fits it, and it gets
the verdict of the class prior. With no page of either class, or in a tie, the verdict is
allow. Rows that repeat are judged each. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.spans import bound
from sensorflow.llm.tables import in_workers, written

#: Letters by which longer words are looked up.
GRAM = 8
#: Weights are whole multiples of one in so many, so that ties are ties.
SCALE = 1_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as texts, both empty without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return (
        lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def fitting_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its action; null without one.

    A rule is (action, host + path) and fits the host and all its subdomains.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        host, path = F.lit(rule[:at]), F.lit(rule[at:])
        own = F.col("host") == host
        below = F.endswith(F.col("host"), F.lit("." + rule[:at]))
        fits = (own | below) & F.startswith(F.col("path"), path)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(action)
    return name, action


# Words of host labels -------------------------------------------------------


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """How often each word stands in the text of the pages."""
    plain = F.regexp_replace(F.lower(F.col(text).cast("string")), r"<[^>]*>", " ")
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word"))
    return words.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label and its words; `labels` is distinct. No dictionary is sent to the tasks.

    Every place of a label meets the words of fewer than GRAM letters that stand there,
    and of the longer ones those that begin with the GRAM letters there; so a label makes
    rows in proportion to its length, whatever the length of words.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    numbered = written(labels.where("label != ''").withColumn("id", F.monotonically_increasing_id()), "labels")
    letters = F.regexp_extract_all("label", F.lit("(?s)."), F.lit(0))

    def grams(letters: Column) -> Column:
        gram = lambda i: F.array_join(F.slice(letters, i, GRAM), "")
        return F.transform(F.sequence(F.lit(1), F.size(letters)), lambda i: F.struct(i.alias("start"), gram(i).alias("gram")))

    places = numbered.select("id", F.explode(bound(letters, grams)).alias("p")).select("id", "p.start", "p.gram")
    sizes = F.sequence(F.lit(1), F.least(F.lit(GRAM - 1), F.length("gram")))
    short = (
        places.select("id", "start", "gram", F.explode(sizes).alias("size"))
        .select("id", "start", F.substring("gram", F.lit(1), F.col("size")).alias("word"))
        .join(counts.where(F.length("word") < GRAM), "word")
    )
    long_words = counts.where(F.length("word") >= GRAM).withColumn("gram", F.substring("word", 1, GRAM))
    long = places.where(F.length("gram") == GRAM).join(long_words, "gram")
    pieces = short.select("id", "start", "word", "n").unionByName(long.select("id", "start", "word", "n"))
    lists = numbered.join(pieces.groupBy("id").agg(F.collect_list(F.struct("start", "word", "n")).alias("pieces")), "id", "left")
    return lists.select("label", "pieces").mapInArrow(in_workers(_segment, total=total), "label string, words array<string>")


def _segment(batches, total):
    for batch in batches:
        names, found = [], []
        for row in batch.to_pylist():
            label, ending = row["label"], {}
            for p in row["pieces"] or []:
                if label.startswith(p["word"], p["start"] - 1):
                    size = len(p["word"])
                    ending.setdefault(p["start"] - 1 + size, []).append((size, p["n"]))
            names.append(label)
            found.append(likeliest_split(label, ending, total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["label", "words"]
        )


def whole(weight: float) -> int:
    """A log-probability as a whole number, so that sums don't depend on their order."""
    return round(weight * SCALE)


def likeliest_split(label: str, ending: dict[int, list[tuple[int, int]]], total: int) -> list[str]:
    """Viterbi over the places of a label; an unknown word is the less likely the longer.

    `ending` has the known words that end at a place, as size and count. The best unknown
    word that ends at a place begins where score plus penalty is highest so far, so the
    work grows with the label and its known words. Of equal splits the last word is the
    shortest.
    """
    unknown, letter = whole(math.log(10 / total)), whole(math.log(10))
    score, back = [0] * (len(label) + 1), [0] * (len(label) + 1)
    best, best_at = 0, 0
    for end in range(1, len(label) + 1):
        options = [(best + unknown - end * letter, best_at - end)]
        options += [(score[end - size] + whole(math.log(n / total)), -size) for size, n in ending.get(end, ())]
        score[end], size = max(options)
        back[end] = -size
        if score[end] + end * letter >= best:
            best, best_at = score[end] + end * letter, end
    words, end = [], len(label)
    while end:
        words.append(label[end - back[end] : end])
        end -= back[end]
    return words[::-1]


# Naive Bayes ----------------------------------------------------------------


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and the words of its labels, for distinct hosts."""
    labels = hosts.select("host", F.explode(F.split("host", NOT_WORD)).alias("label")).where("label != ''")
    words = written(segmented(labels.select("label").distinct(), counts), "segments")
    return (
        labels.join(words, "label")
        .groupBy("host")
        .agg(F.flatten(F.collect_list("words")).alias("words"))
    )


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), NOT_WORD), lambda t: t != "")


def weights(labelled: DataFrame, words: DataFrame) -> tuple[DataFrame, int]:
    """Log-odds of block for each token of the labelled pages, and of the classes, times SCALE.

    `labelled` has host, path and action. Hosts and paths are counted before they are
    split, so a busy host is one row.
    """
    blocked = F.when(F.col("action") == "block", 1).otherwise(0)
    sums = [F.sum(blocked).alias("block"), F.sum(1 - blocked).alias("allow")]
    hosts = labelled.groupBy("host").agg(*sums).join(words, "host")
    paths = labelled.groupBy("path").agg(*sums)
    tokens = hosts.select(F.explode("words").alias("w"), "block", "allow").select(
        F.concat(F.lit("h:"), "w").alias("token"), "block", "allow"
    ).unionByName(
        paths.select(F.explode(path_tokens(F.col("path"))).alias("w"), "block", "allow").select(
            F.concat(F.lit("p:"), "w").alias("token"), "block", "allow"
        )
    )
    counts = written(
        tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "token_classes"
    )
    size = counts.agg(F.count("*").alias("v"), F.sum("block").alias("b"), F.sum("allow").alias("a")).first()
    pages = labelled.agg(*sums).first()
    v, b, a = size["v"], size["b"] or 0, size["a"] or 0
    odds = F.log((F.col("block") + 1) / (F.col("allow") + 1)) + F.lit(math.log((a + v + 1) / (b + v + 1)))
    prior = whole(math.log(((pages["block"] or 0) + 1) / ((pages["allow"] or 0) + 1)))
    return counts.select("token", F.rint(odds * SCALE).cast("long").alias("weight")), prior


def scores(tokens: DataFrame, by: str, weight: DataFrame) -> DataFrame:
    """The summed log-odds of each value of `by`; tokens that no labelled page has say nothing."""
    return tokens.join(weight, "token").groupBy(by).agg(F.sum("weight").alias(f"{by}_score"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and the score (log-odds of block) behind it."""
    host, path = split_url(F.col("url"))
    rule, action = fitting_rule(rules)
    parsed = written(
        pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).select(
            "*", rule.alias("rule"), action.alias("action")
        ),
        "urls",
    )
    counts = written(word_counts(pages, html), "words")
    words = written(host_words(parsed.select("host").distinct(), counts), "host_words")
    weight, prior = weights(parsed.where("action IS NOT NULL"), words)
    open_ = parsed.where("action IS NULL")
    of_host = words.select("host", F.explode("words").alias("w")).select(
        "host", F.concat(F.lit("h:"), "w").alias("token")
    )
    of_path = open_.select("path").distinct().select(
        "path", F.explode(F.transform(path_tokens(F.col("path")), lambda t: F.concat(F.lit("p:"), t))).alias("token")
    )
    host_score = written(scores(of_host, "host", weight), "host_scores")
    path_score = written(scores(of_path, "path", weight), "path_scores")
    score = (
        F.lit(prior).cast("long")
        + F.coalesce(F.col("host_score"), F.lit(0))
        + F.coalesce(F.col("path_score"), F.lit(0))
    ) / SCALE
    found = open_.join(host_score, "host", "left").join(path_score, "path", "left").withColumn("score", score)
    ruled = parsed.where("action IS NOT NULL").withColumn("score", F.lit(None).cast("double"))
    verdict = F.coalesce("action", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return (
        found.select("page_id", "host", "path", "rule", "action", "score")
        .unionByName(ruled)
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    )
