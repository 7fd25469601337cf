"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

Runs of letters in host labels are split into words by a unigram Viterbi search: the split with the largest product of word
probabilities. The lexicon is counted over the delimited tokens of all URLs (paths, and hyphenated host labels), and a word that it
lacks, or has too seldom, costs by its length. Host words and path tokens then go to a multinomial naive Bayes classifier with add-one
smoothing. Its two classes come from labelled pages, where there are such; otherwise from distant labels: a page is of the unwanted
class if a seed word (SEEDS) stands among its host's words.

Lexicon and class counts are tables of all words, however rare; nothing is sent to the driver but totals. Each distinct host is split
once: its runs' substrings are joined with the lexicon, and a run's candidates are searched alone. Each distinct host, and each distinct
sequence of path tokens, is scored once, and a page has the sum of the two.

Defined results: a null url, or one without ://, has an empty host and path and no tokens, and is allowed, as it has no sign of
anything; a host without words is allowed; repeated urls are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime

#: Letters of the longest word that a run is split into, other than unknown ones; cost of an unknown word, and of each of its letters.
LONGEST, UNKNOWN, LETTER = 24, 12.0, 2.5
#: A key with at least one of so many rows is common; there are so many such keys at most.
HOT = 1000
#: Share of all tokens that a common word or a seed has at least.
PRIOR = 1 / 2000
#: Words that mark a host as unwanted.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "dating", "escort", "farm", "gambling", "hack", "jackpot", "keygen", "loan",
    "loans", "nude", "payday", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "track", "viagra", "warez", "webcam", "xxx",
)
#: These are only unwanted beside another of them or a stronger one.
WEAK_SEEDS = ("ads", "cheap", "farm", "track")
#: English words that are common in host names; each counts as often as a word with a share of PRIOR, if it is rarer.
COMMON = (
    "art", "auto", "best", "big", "blog", "book", "books", "bonus", "buy", "car", "city", "club", "code", "data", "day", "deal", "deals", "dev",
    "docs", "expert", "fast", "film", "food", "forum", "free", "fun", "game", "games", "garden", "go", "good", "green", "group", "guide", "health",
    "help", "home", "hot", "house", "info", "job", "jobs", "lab", "learn", "life", "live", "love", "mail", "map", "market", "media", "music", "my",
    "net", "new", "news", "now", "online", "page", "photo", "play", "pro", "river", "school", "science", "shop", "site", "smart", "sport", "store",
    "team", "tech", "the", "time", "tips", "top", "travel", "video", "web", "win", "wiki", "work", "world", "your", "zone",
)

#: (rule, verdict) of op4; a rule is a host, then the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 2)


def rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does. A rule fits its host and all subdomains."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        found, verdict = F.when(fits, text).otherwise(found), F.when(fits, what).otherwise(verdict)
    return found, verdict


def viterbi(run: str, words: list[tuple[int, int, float]]) -> list[str]:
    """The cheapest split of a run; words: (start, end, cost) of those that the lexicon has. Of equal splits that whose last word is longest, and so on backwards.

    The cheapest unknown last word comes from a running minimum, so the time is in proportion to the run and its words.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in sorted(words):
        ends.setdefault(end, []).append((start, cost))
    best, came = [0.0], [0]
    low, at = math.inf, 0  # least best[i] - LETTER * i, and the first such i
    for j in range(1, len(run) + 1):
        if best[j - 1] - LETTER * (j - 1) < low:
            low, at = best[j - 1] - LETTER * (j - 1), j - 1
        found = (low + UNKNOWN + LETTER * j, at)
        for i, cost in ends.get(j, ()):
            found = min(found, (best[i] + cost, i))
        best.append(found[0])
        came.append(found[1])
    out, j = [], len(run)
    while j:
        out.append(run[came[j] : j])
        j = came[j]
    return out[::-1]


def host_runs(host_: Column) -> Column:
    """Runs of letters of a host, without the last label, which rules are for, and labels that are www."""
    labels = F.filter(F.slice(F.split(host_, r"\."), F.lit(1), F.greatest(F.size(F.split(host_, r"\.")) - 1, F.lit(0))), lambda x: x != "www")
    return F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit("([a-z]+)"), F.lit(1))))


def path_tokens(path_: Column) -> Column:
    """Tokens of a path, each behind a slash; numbers are all one token."""
    return F.transform(F.regexp_extract_all(F.lower(path_), F.lit("([a-z]+|[0-9]+)"), F.lit(1)), lambda x: F.concat(F.lit("/"), F.when(x.rlike("^[0-9]"), "#").otherwise(x)))


def lexicon(parts: DataFrame) -> DataFrame:
    """w, n: counts of delimited tokens (letters only) of the rows of host, path: those of paths, and of host labels with hyphens. All of them.

    A whole label is no such token: it may be the concatenated name that has to be split.
    """
    found = F.concat(F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+)"), F.lit(1)), F.regexp_extract_all("host", F.lit("((?<=-)[a-z]+|[a-z]+(?=-))"), F.lit(1)))
    return parts.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def _with_prior(counts: DataFrame) -> tuple[DataFrame, float]:
    """w, n with common words and seeds at a share of PRIOR at least; and the total."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    spark = counts.sparkSession
    known = spark.createDataFrame([(w, total * PRIOR) for w in sorted({*COMMON, *SEEDS})], "w string, n double")
    every = counts.select("w", F.col("n").cast("double").alias("n")).unionByName(known).groupBy("w").agg(F.max("n").alias("n"))
    return every, total * (1 + PRIOR * len({*COMMON, *SEEDS}))


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From id, run: id, start, end, w of all substrings of 2 to LONGEST letters."""
    for batch in batches:
        for k, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for a in range(0, len(run), 1024):
                cut = [(i, j) for i in range(a, min(a + 1024, len(run))) for j in range(i + 2, min(i + LONGEST, len(run)) + 1)]
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(cut)), pa.array([i for i, _ in cut], pa.int32()), pa.array([j for _, j in cut], pa.int32()), pa.array([run[i:j] for i, j in cut])], names=["id", "start", "end", "w"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [viterbi(run, [(x["start"], x["end"], x["cost"]) for x in found or ()]) for run, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["id", "words"])


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words for each distinct host, by the lexicon counts (w, n)."""
    words, total = _with_prior(counts)
    costs = words.select("w", (-F.log(F.col("n") / total)).alias("cost"))
    runs = hosts.select("host", F.posexplode(host_runs(F.col("host"))).alias("at", "run")).withColumn("id", F.md5(F.col("run").cast("binary")))
    runs = runtime.stored(runs, "runs")
    distinct = runs.groupBy("id").agg(F.first("run").alias("run"))
    cut = distinct.mapInArrow(_substrings, "id string, start int, end int, w string")
    known = runtime.stored(cut.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(costs, "w"), "costs")
    found = beside(cut, known, "w").groupBy("id").agg(F.collect_list(F.struct("start", "end", "cost")).alias("found"))
    split = distinct.join(found, "id", "left").select("id", "run", "found").mapInArrow(_split, "id string, words array<string>")
    per = runs.join(split, "id").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(per, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def seeded(words: Column) -> Column:
    """Whether a strong seed stands among a host's words, or two different weak ones."""
    found = F.array_intersect(words, F.array(*(F.lit(w) for w in SEEDS)))
    weak = F.size(F.array_intersect(found, F.array(*(F.lit(w) for w in WEAK_SEEDS))))
    return (F.size(found) > weak) | (weak > 1)


def odds(tokens: DataFrame, urls: DataFrame) -> tuple[DataFrame, float]:
    """Of naive Bayes with add-one smoothing: w, odds (log, of class 1 against 0) from tokens (w, a, b: occurrences in class 0 and 1), and the prior from urls (kind, n)."""
    size = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    n = {r["kind"]: r["n"] for r in urls.collect()}  # two rows
    unseen = size[0] + 1
    log = lambda c, total: F.log((F.col(c) + 1) / float(total + unseen))
    return tokens.select("w", (log("b", size[2]) - log("a", size[1])).alias("odds")), math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))


def beside(rows: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """rows with the figures (key, n, ...) of their key, where n counts the key's rows. Keys with a share of 1 / HOT or more, HOT at most, are sent to the tasks; only the others' rows are dealt by key."""
    total = figures.agg(F.sum("n")).first()[0] or 0
    hot = figures.filter(F.col("n") * HOT >= total)
    rest = [c for c in figures.columns if c not in (key, "n")]
    marked = rows.join(F.broadcast(hot.drop("n").withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.filter("_hot IS NULL").drop("_hot", *rest).join(figures.filter(F.col("n") * HOT < total).drop("n"), key)
    return marked.filter("_hot").drop("_hot").unionByName(cold)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (naive Bayes) and tokens for each row of page_id, url.

    labels: page_id, blocked of some pages, from which the classes are learned; without them they come from the seeds.
    """
    runtime.prepare(pages.sparkSession)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    counts = runtime.stored(lexicon(parts), "lexicon")
    shaped = parts.select("*", path_tokens(F.col("path")).alias("rest")).withColumn("shape", F.md5(F.array_join("rest", " ").cast("binary")))
    seen = runtime.stored(shaped.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest")), "urls")
    names = runtime.stored(seen.groupBy("host").agg(F.sum("n").alias("n")), "hosts")
    shapes = runtime.stored(seen.groupBy("shape").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), "shapes")
    hosts = runtime.stored(segmented(names.select("host"), counts).join(names, "host").withColumn("kind", seeded(F.col("words")).cast("int")), "words")
    runtime.drop(counts, names)
    if labels is None:
        kinds = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(hosts.select("host", "kind"), "host")
        taught = beside(seen.select("host", "shape", "n"), kinds, "host")
    else:
        known = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("blocked").cast("int").alias("kind")).filter("kind IS NOT NULL").dropDuplicates(["page_id"])
        taught = shaped.join(known, "page_id").groupBy("host", "shape", "kind").agg(F.count(F.lit(1)).alias("n"))
    taught = runtime.stored(taught, "taught")
    runtime.drop(seen)
    of_hosts = taught.groupBy("host", "kind").agg(F.sum("n").alias("n")).join(hosts.select("host", F.col("words").alias("t")), "host")
    of_shapes = taught.groupBy("shape", "kind").agg(F.sum("n").alias("n")).join(shapes.select("shape", F.col("rest").alias("t")), "shape")
    seen = of_hosts.select("kind", "n", F.explode("t").alias("w")).unionByName(of_shapes.select("kind", "n", F.explode("t").alias("w")))
    in_class = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    tokens = runtime.stored(seen.groupBy("w").agg(in_class(0).alias("a"), in_class(1).alias("b")), "bayes")
    log_odds, prior = odds(tokens, taught.groupBy("kind").agg(F.sum("n").alias("n")))

    def scored(df: DataFrame, key: str, column: str) -> DataFrame:
        """A token never seen says nothing about either class."""
        each = df.select(key, F.explode(column).alias("w"))
        known = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(log_odds, "w")
        return beside(each, known, "w").groupBy(key).agg(F.sum("odds").alias(key + "_odds"))

    by_host = runtime.stored(hosts.select("host", "n", "words").join(scored(hosts, "host", "words"), "host", "left"), "host-scores")
    by_shape = runtime.stored(shapes.select("shape", "n").join(scored(shapes, "shape", "rest"), "shape", "left"), "shape-scores")
    out = beside(beside(shaped, by_host, "host"), by_shape, "shape")
    x = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("shape_odds", F.lit(0.0))
    out = out.withColumn("p_block", F.when(F.size("words") + F.size("rest") == 0, 0.0).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))))
    found, verdict = rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", found.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block", F.concat("words", "rest").alias("tokens"))
