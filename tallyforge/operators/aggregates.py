"""Groupings of amounts, documents and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents, roundness
from tallyforge.functions.dates import end_of_month, holidays, is_weekend, month
from tallyforge.functions.texts import TOTAL_WORDS, any_word, jaccard, word_set
from tallyforge.operators.sequences import with_groups

BLOCK = 64


def moments(value: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation."""
    return F.avg(value), F.stddev_pop(value)


def coarse(amount: Column, step: int = 100) -> Column:
    """The multiple of step at or below an amount."""
    return (F.floor(cents(amount) / (step * 100)) * step).cast("long")


def matching_amounts(items: DataFrame, key: Column, least: int = 2, min_confidence: float = 0.7) -> DataFrame:
    """Amounts (key) that several items share: items, documents, document types; confidence 0.85, more with items and documents, at most 0.95.

    Rows are dealt by amount and document, and the first of each pair is counted as the document; so a task keeps no table of pairs, and
    rows aren't repeated for each count.
    """
    rows = items.select(key.alias("key"), "doc_id", "doc_type").repartition("key", "doc_id")
    first = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("doc_type")) == 1
    g = rows.withColumn("_new", F.when(first & F.col("doc_id").isNotNull(), 1).otherwise(0)).groupBy("key", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("documents"))
    g = g.groupBy("key").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.count("doc_type").alias("types"))
    c = F.least(F.lit(0.95), 0.85 + F.col("n") / 10 * 0.05 + F.col("documents") / 3 * 0.1)
    return g.filter(F.col("n") >= least).withColumn("confidence", c).filter(F.col("confidence") >= min_confidence)


def recurring_amounts(items: DataFrame, key: Column, more_than: int = 2, min_confidence: float = 0.7) -> DataFrame:
    """Amounts that more than `more_than` items have, where they cross document types or parties, or descriptions differ.

    Descriptions are alike if each two share 60 % of their words. An amount's distinct word sets are compared with one of them first, and
    only where all are near that one, in pairs of blocks of about BLOCK sets.
    """
    d = items.filter("amount > 0").groupBy(key.alias("key"), "description", "doc_type", "party").agg(F.count(F.lit(1)).alias("n"))
    g = d.groupBy("key").agg(F.sum("n").alias("n"), F.countDistinct("doc_type").alias("types"), F.countDistinct("party").alias("parties"), F.countDistinct("description").alias("names")).filter(F.col("n") > more_than)
    sets = d.filter("description IS NOT NULL").select("key", F.array_sort(word_set(F.col("description"))).alias("w")).distinct()
    one = sets.groupBy("key").agg(F.min("w").alias("p"), F.count(F.lit(1)).alias("k"))
    dealt = sets.join(one, "key").withColumn("block", F.pmod(F.xxhash64("w"), F.ceil(F.col("k") / BLOCK)))
    dealt = dealt.groupBy("key", "block").agg(F.collect_list("w").alias("ws"), F.min(jaccard(F.col("w"), F.col("p"))).alias("low"))
    near = dealt.groupBy("key").agg((F.min("low") >= 0.6).alias("near"))
    left = dealt.join(near.filter("near"), "key", "left_semi").select("key", "block", "ws")
    pairs = left.join(left.select("key", F.col("block").alias("block2"), F.col("ws").alias("ws2")), "key").filter("block <= block2")
    every = pairs.groupBy("key").agg(F.min(F.forall("ws", lambda x: F.forall("ws2", lambda y: jaccard(x, y) >= 0.6))).alias("every"))
    out = g.join(near, "key", "left").join(every, "key", "left")
    out = out.withColumn("alike", (F.col("names") <= 1) | (F.coalesce("near", F.lit(True)) & F.coalesce("every", F.lit(False))))
    c = 0.7 + 0.1 * F.least(F.lit(1.0), F.col("n") / 5) + 0.1 * F.least(F.lit(1.0), F.col("types") / 3) + F.when(~F.col("alike"), 0.15).otherwise(0.0) + F.when(F.col("parties") > 1, 0.2).otherwise(0.0)
    out = out.withColumn("confidence", F.least(F.lit(0.95), c)).filter((F.col("types") > 1) | (F.col("parties") > 1) | ~F.col("alike"))
    return out.filter(F.col("confidence") >= min_confidence).drop("names", "near", "every")


def frequency_anomalies(items: DataFrame, key: Column, z: float = 2.5, least: int = 5) -> DataFrame:
    """Amounts whose number of items stands out (|z| > z) among all amounts that occur more than once, if there are `least` of those."""
    n = items.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    s = n.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    # One row of statistics.
    j = n.crossJoin(F.broadcast(s)).filter((F.col("k") >= least) & (F.col("std") > 0))
    return j.withColumn("z", (F.col("n") - F.col("mean")) / F.col("std")).filter(F.abs("z") > z).select("key", "n", "z")


def distribution_anomalies(items: DataFrame, z: float = 2.5, least_items: int = 5, least_docs: int = 5) -> DataFrame:
    """Documents whose mean item amount stands out among those of their type and party."""
    d = items.groupBy("doc_id", "doc_type", "party").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("amount"))).alias("s")).filter(F.col("n") >= least_items)
    d = d.withColumn("mean_amount", F.col("s") / F.col("n") / 100)
    mean, std = moments(F.col("mean_amount"))
    d = with_groups(d, ("doc_type", "party"), k=F.count(F.lit(1)), group_mean=mean, std=std)
    return d.filter((F.col("k") >= least_docs) & (F.col("std") > 0)).withColumn("z", (F.col("mean_amount") - F.col("group_mean")) / F.col("std")).filter(F.abs("z") > z)


def category_averages(items: DataFrame) -> DataFrame:
    return items.filter("amount > 0").groupBy("cost_code").agg((F.sum(cents(F.col("amount"))) / F.count(F.lit(1)) / 100).alias("mean"), F.count(F.lit(1)).alias("n"))


def mismatched_totals(documents: DataFrame, items: DataFrame, per_mille: int = 10) -> DataFrame:
    """Documents whose stated total differs from the sum of their items by more than per_mille thousandths of the total."""
    s = items.groupBy("doc_id").agg(F.sum(cents(F.col("amount"))).alias("item_cents"), F.count(F.lit(1)).alias("n"))
    j = documents.select("doc_id", cents(F.col("total")).alias("total_cents")).join(s, "doc_id").withColumn("difference", F.col("total_cents") - F.col("item_cents"))
    return j.filter(F.abs("difference") * 1000 > per_mille * F.abs("total_cents"))


def total_lines(items: DataFrame, per_mille: int = 10, more_than: int = 5) -> DataFrame:
    """Items named as totals, in documents of more than `more_than` items, that differ from the sum of the document's other items."""
    w = Window.partitionBy("doc_id")
    t = items.withColumns({"_n": F.count(F.lit(1)).over(w), "rest": F.sum(cents(F.col("amount"))).over(w) - cents(F.col("amount"))})
    return t.filter((F.col("_n") > more_than) & any_word(F.col("description"), TOTAL_WORDS) & (F.abs(cents(F.col("amount")) - F.col("rest")) * 1000 > per_mille * F.abs(F.col("rest")))).drop("_n")


def systematic_rounding(items: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """Parties of at least `least` items, with the share of items whose roundness is 0.5 or more, and the mean roundness; confidence where the share is reached."""
    g = items.withColumn("r", roundness(F.col("amount"))).groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r") >= 0.5, 1).otherwise(0)).alias("round"), F.avg("r").alias("mean_roundness"))
    g = g.filter(F.col("n") >= least).withColumn("share", F.col("round") / F.col("n"))
    return g.withColumn("confidence", F.when(F.col("share") >= share, F.least(F.lit(0.95), 0.75 + 2 * (F.col("share") - share))))


def common_terms(items: DataFrame, part: int = 2) -> DataFrame:
    """By cost code: words of over three letters in at least two, and one of `part`, of the distinct descriptions."""
    d = items.select("cost_code", "description").distinct()
    n = d.groupBy("cost_code").agg(F.count(F.lit(1)).alias("of"))
    w = d.select("cost_code", F.explode(F.filter(word_set(F.col("description")), lambda x: F.length(x) > 3)).alias("word")).groupBy("cost_code", "word").agg(F.count(F.lit(1)).alias("n"))
    return w.join(n, "cost_code").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("of") / part)))


def end_of_month_clustering(documents: DataFrame, by: tuple[str, ...] = ("party",), factor: float = 2.0, least: int = 5, days: int = 3, least_late: int = 3) -> DataFrame:
    """Per group and month with `least` documents: those in the last `days` days against the expected n * days / 30. clustered: over factor times that, and least_late."""
    g = documents.groupBy(*by, month(F.col("date_created")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(end_of_month(F.col("date_created"), days), 1).otherwise(0)).alias("late")).filter(F.col("n") >= least)
    return g.withColumn("clustered", (F.col("late") * 30 > factor * F.col("n") * days) & (F.col("late") >= least_late))


def end_of_month_anomalies(documents: DataFrame, factor: float = 2.0, least: int = 3, days: int = 3) -> DataFrame:
    """Documents of the last days of their month, where their party's share of documents, or of money, in those days exceeds factor times the days' share of the month."""
    late = end_of_month(F.col("date_created"), days)
    d = documents.withColumns({"month": month(F.col("date_created")), "late": late, "dim": F.dayofmonth(F.last_day("date_created"))})
    d = with_groups(d, ("party", "month"), n=F.count(F.lit(1)), k=F.sum(F.when(F.col("late"), 1).otherwise(0)), s=F.sum(cents(F.col("total"))), m=F.sum(F.when(F.col("late"), cents(F.col("total"))).otherwise(0)))
    ratio = F.greatest(F.col("k") / F.col("n"), F.col("m") / F.col("s")) / (days / F.col("dim"))
    return d.withColumn("ratio", ratio).filter((F.col("n") >= least) & F.col("late") & (F.col("ratio") > factor))


def weekend_timing(documents: DataFrame) -> DataFrame:
    """Per document type: documents, those on weekends, and whether they exceed 1.5 times 2/7."""
    g = documents.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(is_weekend(F.col("date_created")), 1).otherwise(0)).alias("weekend"))
    return g.withColumn("unusual", (F.col("weekend") * 7 > F.col("n") * 3) & (F.col("weekend") >= 3))


def holiday_timing(documents: DataFrame, first: int, last: int) -> DataFrame:
    """Documents dated on a US holiday or a day beside it, by holiday. first, last: years. The calendar has ten rows a year and three days for each."""
    days = holidays(documents.sparkSession, first, last).select("name", F.explode(F.array(F.date_sub("day", 1), "day", F.date_add("day", 1))).alias("date_created")).distinct()
    return documents.join(days, "date_created").groupBy("name").agg(F.countDistinct("doc_id").alias("documents"))


def project_timeline(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with their items' number and sum, numbered by date in their project, nulls last."""
    s = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("item_total"))
    w = Window.partitionBy("project_id").orderBy(F.asc_nulls_last("date_created"), "doc_id")
    return documents.join(s, "doc_id", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "event": F.row_number().over(w)})


def key_periods(documents: DataFrame, by: tuple[str, ...] = ("party",), factor: float = 1.5) -> DataFrame:
    """Months with over factor times the group's mean of documents a month."""
    m = documents.groupBy(*by, month(F.col("date_created")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("mean", F.avg("n").over(Window.partitionBy(*by))).filter(F.col("n") > factor * F.col("mean"))


def price_variance(items: DataFrame, by: tuple[str, ...], price: Column) -> DataFrame:
    """Number, least, greatest, mean and population deviation of a price in each group, and their ratio."""
    g = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(price).cast("double").alias("low"), F.max(price).cast("double").alias("high"), (F.sum(cents(price)) / F.count(F.lit(1)) / 100).alias("mean"), F.stddev_pop(price.cast("double")).alias("std"))
    return g.withColumn("cv", F.col("std") / F.col("mean"))


def markup_variance(items: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Markup over quantity * unit price, in percent: spread in each group. inconsistent: variance over 5 or range over 10."""
    cost = F.col("quantity").cast("double") * F.col("unit_price").cast("double")
    m = items.filter("quantity > 0 AND unit_price > 0").withColumn("m", (F.col("amount").cast("double") - cost) / cost * 100)
    g = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"), F.max("m").alias("high"), F.avg("m").alias("mean"), F.var_pop("m").alias("variance")).filter("n >= 2")
    c = 0.7 + F.least(F.lit(0.15), F.col("variance") / 100) + F.least(F.lit(0.1), (F.col("high") - F.col("low")) / 100) + F.least(F.lit(0.1), 0.02 * (F.col("n") - 2))
    return g.withColumns({"inconsistent": (F.col("variance") > 5) | (F.col("high") - F.col("low") > 10), "confidence": F.least(F.lit(0.95), c)})


def counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by a column; null is unknown."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
