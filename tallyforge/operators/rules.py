"""Rule detectors: each gives one row for each finding, with its confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents, near_bin, near_bins, roundness
from tallyforge.functions.dates import day_bin
from tallyforge.functions.texts import CONSTRUCTION, DELIVERY, EXCLUDED_COST_CODES, HVAC, any_word, has_part, jaccard, suspiciousness, word_set
from tallyforge.operators.aggregates import category_averages
from tallyforge.operators.components import components


def reappearing_amounts(items: DataFrame, tolerance_cents: int = 1) -> DataFrame:
    """Rejected items (or items of rejected documents) whose amount occurs in a strictly later document of the project.

    rejected_amount_in_invoice (0.9) if one is an invoice, else reappearing_amount (0.75, less if descriptions agree, more if they don't).
    The join is on project and a bin much wider than the tolerance, so that a rejected item lies in one, at an edge in two; then the exact test.
    """
    wide = 16 * (tolerance_cents + 1)
    r = items.filter("item_status = 'rejected' OR status = 'rejected'").select("project_id", "item_id", "doc_id", F.col("date_created").alias("rejected_on"), "description", cents(F.col("amount")).alias("rc"))
    r = r.withColumn("bin", F.explode(F.array_distinct(F.array(*(F.floor((F.col("rc") + k) / wide) for k in (-tolerance_cents, tolerance_cents))))))
    later = items.select("project_id", cents(F.col("amount")).alias("c"), F.col("item_id").alias("later_id"), F.col("date_created").alias("later_on"), F.col("doc_type").alias("later_type"), F.col("description").alias("later_text"))
    later = later.withColumn("bin", F.floor(F.col("c") / wide))
    j = r.join(later, ["project_id", "bin"]).filter((F.col("later_on") > F.col("rejected_on")) & (F.abs(F.col("c") - F.col("rc")) <= tolerance_cents))
    g = j.groupBy("project_id", "item_id", "rc").agg(F.count(F.lit(1)).alias("n"), F.min("later_on").alias("first_later"), F.max(F.col("later_type") == "invoice").alias("invoice"), F.avg(jaccard(word_set(F.col("description")), word_set(F.col("later_text")))).alias("alike"))
    soft = 0.75 + F.when(F.col("alike") > 0.8, -0.15).when(F.col("alike") < 0.3, 0.15).otherwise(0.0)
    return g.withColumns({"kind": F.when(F.col("invoice"), "rejected_amount_in_invoice").otherwise("reappearing_amount"), "confidence": F.when(F.col("invoice"), 0.9).otherwise(soft)})


def unusually_large(items: DataFrame, least: float = 100_000.0, ratio: float = 3.0) -> DataFrame:
    """Items over `least`, outside excluded cost codes, at over `ratio` times their cost code's mean (or over twice `least` without one); confidence 0.7 + 0.05 (r - ratio), at most 0.95."""
    a = category_averages(items).select("cost_code", "mean")
    big = items.filter((F.col("amount") > least) & ~F.lower("cost_code").isin(*EXCLUDED_COST_CODES)).join(a, "cost_code", "left").withColumn("ratio", F.col("amount").cast("double") / F.col("mean"))
    big = big.filter((F.col("ratio") > ratio) | (F.col("mean").isNull() & (F.col("amount") > 2 * least)))
    return big.withColumn("confidence", F.least(F.lit(0.95), 0.7 + 0.05 * (F.coalesce("ratio", F.lit(ratio)) - ratio)))


def large_amounts(items: DataFrame, least: float = 100_000.0) -> DataFrame:
    """By cost code: items over `least`, with the code's mean and the greatest ratio to it."""
    a = category_averages(items).select("cost_code", "mean")
    return items.filter(F.col("amount") > least).groupBy("cost_code").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("high")).join(a, "cost_code").withColumn("ratio", F.col("high").cast("double") / F.col("mean"))


def suspicious_descriptions(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Items whose description's suspiciousness reaches the threshold; confidence 0.6 + 0.3 score."""
    return items.withColumn("score", suspiciousness(F.col("description"), F.col("amount"))).filter(F.col("score") >= threshold).withColumn("confidence", 0.6 + 0.3 * F.col("score"))


def round_amounts(items: DataFrame, least: float = 1000.0, threshold: float = 0.7) -> DataFrame:
    """Items of at least `least` whose amount is round: score of the threshold or more."""
    return items.filter(F.col("amount") >= least).withColumn("score", roundness(F.col("amount"))).filter(F.col("score") >= threshold)


def missing_change_orders(items: DataFrame, documents: DataFrame, least: float = 5000.0, per_mille: int = 10) -> DataFrame:
    """Payment and invoice items over `least` without an earlier change order of the project within per_mille, or with only rejected ones.

    Confidence 0.8, 0.1 more over 10,000, 0.05 more with a word of changed scope; at most 0.95.
    """
    p = items.filter(F.col("doc_type").isin("payment_app", "invoice") & (F.col("amount") > least)).select("project_id", "item_id", "doc_id", "description", "amount", F.col("date_created").alias("billed"), near_bin(F.col("amount"), per_mille).alias("at"))
    o = documents.filter("doc_type = 'change_order'").select(F.col("project_id").alias("project"), cents(F.col("total")).alias("oc"), F.col("date_created").alias("ordered"), "status", F.explode(near_bins(F.col("total"), per_mille)).alias("bin"))
    c = cents(F.col("amount"))
    # An equality join on project and bin of the amount; with the bin among the groups' keys, rows stay where the join has them.
    j = p.join(o, (p["project_id"] == o["project"]) & (F.col("at") == F.col("bin")) & (F.col("ordered") <= F.col("billed")) & (F.abs(F.col("oc") - c) * 1000 <= per_mille * c), "left").drop("project", "bin")
    g = j.groupBy("project_id", "at", "doc_id", "item_id", "description", "amount").agg(F.count("status").alias("orders"), F.coalesce(F.sum(F.when(F.col("status") != "rejected", 1)), F.lit(0)).alias("valid")).drop("at")
    scope = any_word(F.col("description"), ("add", "extra", "additional", "new", "change", "modify"))
    conf = F.least(F.lit(0.95), 0.8 + F.when(F.col("amount") > 10_000, 0.1).otherwise(0.0) + F.when(scope, 0.05).otherwise(0.0))
    return g.filter("valid = 0").withColumns({"kind": F.when(F.col("orders") > 0, "rejected change order").otherwise("no change order"), "confidence": conf})


def math_errors(items: DataFrame, documents: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Checks that fail, with the difference: quantity times unit price against amount; document total against its items. benefit: who bills more than the parts say."""
    q = (F.col("quantity") * cents(F.col("unit_price"))).alias("expected")
    a = items.filter("quantity > 0 AND unit_price > 0").select("doc_id", F.lit("quantity_price").alias("check"), "item_id", q, cents(F.col("amount")).alias("stated"))
    s = items.groupBy("doc_id").agg(F.sum(cents(F.col("amount"))).alias("expected"))
    b = documents.join(s, "doc_id").select("doc_id", F.lit("document_total").alias("check"), F.lit(None).cast("string").alias("item_id"), "expected", cents(F.col("total")).alias("stated"))
    e = a.unionByName(b).withColumn("difference", F.col("stated") - F.col("expected")).filter(F.abs("difference") > tolerance * 100)
    return e.withColumns({"benefit": F.col("difference") > 0, "confidence": F.least(F.lit(0.98), 0.85 + F.least(F.lit(0.13), F.abs("difference") / F.abs("expected")))})


def math_error_summary(items: DataFrame, documents: DataFrame) -> DataFrame:
    """By check and party: failures, those that benefit the biller, and the net difference in cents. systematic: three or more of them benefit."""
    e = math_errors(items, documents).join(documents.select("doc_id", "party"), "doc_id")
    g = e.groupBy("check", "party").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("benefit"), 1).otherwise(0)).alias("benefits"), F.sum("difference").alias("net"))
    return g.withColumn("systematic", F.col("benefits") >= 3)


def description_groups(items: DataFrame, by: tuple[str, ...] = (), least: float = 0.3) -> DataFrame:
    """Distinct descriptions (of each group of `by`) with their group of like ones: by..., description, like, the smallest description that is linked to it, directly or not.

    A link: blank-separated, lower-cased words in common are `least` or more of those in either. Two such descriptions share one of the
    rarest words of each, as many as the share leaves open, so they are joined on those words and then compared; only distinct
    descriptions are, and rare words come first. Null and blank descriptions are alike only to themselves.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("description"), r"\s+"), lambda x: x != ""))
    d = items.select(*by, "description").distinct().withColumn("id", F.xxhash64(*by, "description"))
    w = d.withColumn("w", words).filter(F.size("w") > 0)
    often = w.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    per = w.select("id", F.explode("w").alias("word")).join(often, "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("rare"))
    keep = F.size("rare") - F.ceil(F.size("rare") * least).cast("int") + 1
    w = w.join(per, "id")
    s = w.select(*by, "id", "w", F.explode(F.slice("rare", F.lit(1), keep)).alias("word"))
    other = s.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("id").alias("id2"), F.col("w").alias("w2"), F.col("word").alias("word2"))
    on = (F.col("word") == F.col("word2")) & (F.col("id") < F.col("id2"))
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    links = s.join(other, on).filter(jaccard(F.col("w"), F.col("w2")) >= least).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    roots = d.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = roots.groupBy("root").agg(F.min("description").alias("like"))
    return roots.join(names, "root").select(*by, "description", "like")


def similar_items_prices(items: DataFrame, least_cv: float = 0.2, column: str = "description") -> DataFrame:
    """Descriptions (or groups of them: column) with two or more unit prices whose coefficient of variation exceeds least_cv."""
    p = F.col("amount").cast("double") / F.col("quantity")
    g = items.filter("quantity > 0").withColumn("p", p).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("high"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))
    g = g.filter("n >= 2").withColumn("cv", F.col("std") / F.col("mean")).filter(F.col("cv") > least_cv)
    c = 0.7 + F.least(F.lit(0.15), 0.3 * F.col("cv")) + F.least(F.lit(0.1), 0.1 * (F.col("high") - F.col("low")) / F.col("mean")) + F.least(F.lit(0.1), 0.02 * (F.col("n") - 2))
    return g.withColumn("confidence", F.least(F.lit(0.95), c))


def outlier_pricing(items: DataFrame) -> DataFrame:
    """Items whose unit price is over twice, or under half, their description's mean."""
    p = items.filter("quantity > 0").withColumn("price", F.col("amount").cast("double") / F.col("quantity"))
    g = p.groupBy(F.col("description").alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))
    p = p.join(g, F.col("description").eqNullSafe(F.col("_d"))).drop("_d")
    return p.filter((F.col("n") >= 2) & ((F.col("price") > 2 * F.col("mean")) | (F.col("price") < 0.5 * F.col("mean"))))


def hvac_duplicates(items: DataFrame, key: Column) -> DataFrame:
    """Amounts (key) that two or more items have, of which two name HVAC equipment, or one names it and one a delivery; confidence 0.95."""
    hvac, delivery = has_part(F.col("description"), HVAC).cast("int"), has_part(F.col("description"), DELIVERY).cast("int")
    g = items.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(hvac).alias("hvac"), F.sum(delivery).alias("delivery"))
    return g.filter("n >= 2 AND (hvac >= 2 OR (hvac > 0 AND delivery > 0))").withColumn("confidence", F.lit(0.95))


def explained(anomalies: DataFrame) -> DataFrame:
    """Rows of features() with reasons: why each is unusual by fixed thresholds, or that its features are together."""
    reasons = F.array_compact(F.array(F.when(F.col("amount") > 100_000, "large amount"), F.when(F.col("length") < 5, "very short description"), F.when((F.col("round") > 0.5) & (F.col("amount") > 10_000), "round large amount"), F.when(F.col("day") >= 28, "end of month")))
    return anomalies.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("features unusual together"))))


def duplicate_in_document(items: DataFrame) -> DataFrame:
    """Amounts that stand more than once in a document."""
    return items.groupBy("doc_id", "amount").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("description").alias("descriptions")).filter("n > 1")


def threshold_bypass(documents: DataFrame, most: float = 50_000.0, total: float = 100_000.0, gap: int = 90) -> DataFrame:
    """Change orders of a project under `most`, in groups of two or more with at most `gap` days between neighbours, whose sum is over `total`."""
    w = Window.partitionBy("project_id").orderBy("date_created", "doc_id")
    d = documents.filter((F.col("doc_type") == "change_order") & (F.col("total") < most))
    d = d.withColumn("_new", F.when(F.datediff("date_created", F.lag("date_created").over(w)) <= gap, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy("project_id", "island").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("sum"), F.min("date_created").alias("start"), F.max("date_created").alias("end"))
    return g.filter((F.col("n") >= 2) & (F.col("sum") > total))


def strategic_timing(documents: DataFrame, low: int = 2, high: int = 14) -> DataFrame:
    """Change orders dated low to high days after a payment application of the project; the nearest such application."""
    at = day_bin(F.col("date_created"), high + 1)
    p = documents.filter("doc_type = 'payment_app'").select("project_id", F.col("doc_id").alias("payment_id"), F.col("date_created").alias("paid"), F.explode(F.array(at, at + 1)).alias("bin"))
    o = documents.filter("doc_type = 'change_order'").select("project_id", F.col("doc_id").alias("order_id"), F.col("date_created").alias("ordered"), at.alias("bin"))
    j = o.join(p, ["project_id", "bin"]).withColumn("days", F.datediff("ordered", "paid")).filter(F.col("days").between(low, high)).drop("bin")
    w = Window.partitionBy("order_id").orderBy("days", "payment_id")
    return j.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def recurring_follow_ups(documents: DataFrame, days: int = 10) -> DataFrame:
    """Projects where at least two, and half, of the payment applications are followed by a change order within `days` days."""
    at = day_bin(F.col("date_created"), days + 1)
    p = documents.filter("doc_type = 'payment_app'").select("project_id", F.col("doc_id").alias("payment_id"), F.col("date_created").alias("paid"), at.alias("bin"))
    o = documents.filter("doc_type = 'change_order'").select("project_id", F.col("date_created").alias("ordered"), F.explode(F.array(at - 1, at)).alias("bin")).distinct()
    f = p.join(o, ["project_id", "bin"]).filter(F.datediff("ordered", "paid").between(0, days)).select("project_id", "payment_id").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("followed"))
    n = p.groupBy("project_id").agg(F.count(F.lit(1)).alias("payments"))
    return n.join(f, "project_id").filter("followed >= 2 AND followed * 2 >= payments")


def chronological_inconsistencies(documents: DataFrame, early: int = 5, late: int = 30) -> DataFrame:
    """Documents received over `early` days before their date, or over `late` days after it."""
    d = documents.withColumn("days", F.datediff("date_received", "date_created"))
    return d.filter((F.col("days") < -early) | (F.col("days") > late)).withColumn("kind", F.when(F.col("days") < 0, "received before created").otherwise("received late"))


def scope_inconsistencies(items: DataFrame, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """Pairs of items of a project with the same amount, in documents of different types, whose descriptions overlap a little: Jaccard from low to high."""
    s = items.select("project_id", cents(F.col("amount")).alias("c"), "item_id", "doc_type", word_set(F.col("description")).alias("w"))
    a, b = s.select("project_id", "c", *(F.col(x).alias("a_" + x) for x in ("item_id", "doc_type", "w"))), s.select("project_id", "c", *(F.col(x).alias("b_" + x) for x in ("item_id", "doc_type", "w")))
    j = a.join(b, ["project_id", "c"]).filter("a_item_id < b_item_id AND a_doc_type != b_doc_type").withColumn("alike", jaccard(F.col("a_w"), F.col("b_w")))
    return j.filter(F.col("alike").between(low, high)).drop("a_w", "b_w")


def interconnected_changes(documents: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Three consecutive change orders of a project that share at least `least` construction terms."""
    terms = F.array(*(F.lit(x) for x in CONSTRUCTION))
    t = items.filter("doc_type = 'change_order'").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(F.array_intersect(word_set(F.col("description")), terms)))).alias("t"))
    w = Window.partitionBy("project_id").orderBy("date_created", "doc_id")
    d = documents.filter("doc_type = 'change_order'").join(t, "doc_id").withColumns({"t2": F.lead("t").over(w), "t3": F.lead("t", 2).over(w)})
    return d.withColumn("shared", F.array_intersect(F.array_intersect("t", "t2"), "t3")).filter(F.size("shared") >= least).select("project_id", "doc_id", F.array_sort("shared").alias("shared"))


def features(items: DataFrame) -> DataFrame:
    """What an anomaly model sees of an item: amount, whether it has a quantity and a unit price, length of its description, whether it is a multiple of 1000, day of month."""
    return items.select(
        "item_id", "doc_id", F.col("amount").cast("double").alias("amount"), F.col("quantity").isNotNull().cast("int").alias("has_quantity"), F.col("unit_price").isNotNull().cast("int").alias("has_price"),
        F.length(F.coalesce("description", F.lit(""))).alias("length"), (cents(F.col("amount")) % 100_000 == 0).cast("int").alias("round"), F.dayofmonth("date_created").alias("day"),
    )


def scaled_distance(items: DataFrame, least: float = 3.0) -> DataFrame:
    """Items far from the centre: the root of the sum of squared standard scores of amount, length of description and day, over all items."""
    f = features(items)
    s = f.agg(*(g(c).alias(f"{n}_{c}") for c in ("amount", "length", "day") for n, g in (("m", F.avg), ("s", F.stddev_pop))))
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in ("amount", "length", "day")]
    # One row of statistics.
    return f.crossJoin(F.broadcast(s)).withColumn("distance", F.sqrt(sum((x * x for x in z), F.lit(0.0)))).filter(F.col("distance") >= least).select(*f.columns, "distance")
