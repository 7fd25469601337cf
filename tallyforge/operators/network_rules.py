"""Rules over a project's documents and their relations: timing of change orders, dates against references, amounts without a link, contradictions, fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents
from tallyforge.functions.dates import holidays
from tallyforge.operators.detectors import FEES

#: Words that make a fee suspicious (fixed values).
MODIFIERS = ("additional", "supplemental", "extra", "special", "custom", "specific", "extended", "misc", "miscellaneous")
#: Authorised markup in percent where no contract states one; over how many times that a markup is flagged (fixed values).
AUTHORISED, EXCESS = 15.0, 1.2


def orders_between_payments(documents: DataFrame) -> DataFrame:
    """project_id, payment_id, next_id, orders, n: change orders of a project dated after one of its payment applications and before the next, where there are any; ids in order. Equal dates are neither after nor before. Confidence 0.85."""
    d = documents.filter("date_created IS NOT NULL AND doc_type IN ('payment_app', 'change_order')").select("project_id", "doc_id", "date_created", (F.col("doc_type") == "payment_app").alias("pays"))
    by = Window.partitionBy("project_id")
    p = d.filter("pays").withColumns({"next_id": F.lead("doc_id").over(by.orderBy("date_created", "doc_id")), "until": F.lead("date_created").over(by.orderBy("date_created", "doc_id"))})
    # In order of dates, orders before payments of their day, so that an order's last payment is of an earlier day.
    both = d.filter("NOT pays").select("project_id", "doc_id", "date_created", F.lit(0).alias("side"), F.lit(None).cast("struct<payment_id:bigint,next_id:bigint,until:date>").alias("pay"))
    both = both.unionByName(p.select("project_id", "doc_id", "date_created", F.lit(1).alias("side"), F.struct(F.col("doc_id").cast("long").alias("payment_id"), F.col("next_id").cast("long").alias("next_id"), "until").alias("pay")))
    last = F.last("pay", ignorenulls=True).over(by.orderBy("date_created", "side", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    o = both.withColumn("pay", last).filter("side = 0 AND pay.until > date_created")
    g = o.groupBy("project_id", "pay.payment_id", "pay.next_id").agg(F.array_sort(F.collect_list("doc_id")).alias("orders"))
    return g.withColumns({"n": F.size("orders"), "confidence": F.lit(0.85)})


def fiscal_clusters(documents: DataFrame, least: int = 2) -> DataFrame:
    """project_id, period, n, confidence: `least` or more change orders of a project dated from the 28th of a month (2023-5), or from the 25th of a quarter's last month (2023-Q1). Confidence 0.8."""
    d = documents.filter("doc_type = 'change_order' AND date_created IS NOT NULL")
    year, month, day = F.year("date_created").cast("string"), F.month("date_created"), F.dayofmonth("date_created")
    periods = F.array_compact(F.array(F.when(day >= 28, F.concat_ws("-", year, month.cast("string"))), F.when((month % 3 == 0) & (day >= 25), F.concat(year, F.lit("-Q"), F.floor(month / 3).cast("string")))))
    g = d.select("project_id", F.explode(periods).alias("period")).groupBy("project_id", "period").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= least).withColumn("confidence", F.lit(0.8))


def referenced_before_existing(relationships: DataFrame, documents: DataFrame) -> DataFrame:
    """source_doc_id, target_doc_id, relationship_type, days: relations from a document to one that is dated later, by days."""
    d = documents.select("doc_id", "date_created")
    j = relationships.join(d.select(F.col("doc_id").alias("source_doc_id"), F.col("date_created").alias("referring")), "source_doc_id").join(d.select(F.col("doc_id").alias("target_doc_id"), F.col("date_created").alias("existing")), "target_doc_id")
    return j.filter("referring < existing").select("source_doc_id", "target_doc_id", "relationship_type", F.datediff("existing", "referring").alias("days"))


def unlinked_orders(items: DataFrame, documents: DataFrame, relationships: DataFrame) -> DataFrame:
    """project_id, payment_id, order_id, cents, issue, confidence: change orders whose amount is that of an item or the total of a payment application or invoice of the project, without a relation between the two in either direction.

    rejected_co_amount_in_payment (0.95) for a rejected order, else unlinked_matching_amount (0.85). Equal amounts are an equality join.
    """
    pays = documents.filter("doc_type IN ('payment_app', 'invoice')")
    amounts = pays.select("project_id", "doc_id", cents(F.col("total")).alias("cents"))
    amounts = amounts.unionByName(items.join(pays.select("doc_id"), "doc_id", "left_semi").select("project_id", "doc_id", cents(F.col("amount")).alias("cents"))).filter("cents != 0").distinct()
    orders = documents.filter("doc_type = 'change_order'").select("project_id", F.col("doc_id").alias("order_id"), cents(F.col("total")).alias("cents"), "status")
    j = amounts.withColumnRenamed("doc_id", "payment_id").join(orders, ["project_id", "cents"])
    linked = relationships.select(F.col("source_doc_id").alias("payment_id"), F.col("target_doc_id").alias("order_id"))
    linked = linked.unionByName(relationships.select(F.col("target_doc_id").alias("payment_id"), F.col("source_doc_id").alias("order_id"))).distinct()
    j = j.join(linked, ["payment_id", "order_id"], "left_anti")
    bad = F.coalesce(F.col("status") == "rejected", F.lit(False))
    return j.select("project_id", "payment_id", "order_id", "cents", F.when(bad, "rejected_co_amount_in_payment").otherwise("unlinked_matching_amount").alias("issue"), F.when(bad, 0.95).otherwise(0.85).alias("confidence"))


def contradictions(documents: DataFrame, relationships: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """kind, doc_id, other_id, reference, status, other_status, confidence (0.9): what documents say against each other about approval.

    contradictory_approval: a document whose meta_data (JSON) has that flag set, with its own status. related_documents: of two related
    documents one approved, one rejected. conflicting_reference_status: two related documents, the first with a status, that give another
    document different statuses: references (doc_id, reference, status), a document's first status of each reference (the smallest).
    """
    null = F.lit(None).cast("string")
    flag = F.try_variant_get(F.try_parse_json("meta_data"), "$.contradictory_approval", "boolean")
    own = documents.filter(flag) if "meta_data" in documents.columns else documents.filter("false")
    out = own.select(F.lit("contradictory_approval").alias("kind"), "doc_id", F.lit(None).cast("long").alias("other_id"), null.alias("reference"), "status", null.alias("other_status"))
    s = documents.select("doc_id", "status").filter("status IS NOT NULL")
    pairs = relationships.select(F.least("source_doc_id", "target_doc_id").alias("doc_id"), F.greatest("source_doc_id", "target_doc_id").alias("other_id")).filter("doc_id != other_id").distinct()
    j = pairs.join(s, "doc_id").join(s.select(F.col("doc_id").alias("other_id"), F.col("status").alias("other_status")), "other_id")
    odd = F.array_sort(F.array("status", "other_status")) == F.array(F.lit("approved"), F.lit("rejected"))
    out = out.unionByName(j.filter(odd).select(F.lit("related_documents").alias("kind"), "doc_id", "other_id", null.alias("reference"), "status", "other_status"))
    if references is not None:
        first = references.filter("status IS NOT NULL AND reference IS NOT NULL").groupBy("doc_id", "reference").agg(F.min("status").alias("said"))
        both = pairs.join(first, "doc_id").join(first.select(F.col("doc_id").alias("other_id"), "reference", F.col("said").alias("other_said")), ["other_id", "reference"])
        known = s.select("doc_id").distinct()
        # Either document may be the one with a status of its own.
        either = both.join(known, "doc_id", "left_semi").unionByName(both.join(known.withColumnRenamed("doc_id", "other_id"), "other_id", "left_semi").select(*both.columns)).distinct()
        out = out.unionByName(either.filter("said != other_said").select(F.lit("conflicting_reference_status").alias("kind"), "doc_id", "other_id", "reference", F.col("said").alias("status"), F.col("other_said").alias("other_status")))
    return out.withColumn("confidence", F.lit(0.9))


def unauthorised_fees(items: DataFrame, contracts: DataFrame, least: float = 100.0) -> DataFrame:
    """item_id, doc_id, project_id, authorised, modified, confidence of items over `least` with a fee word that the project's contracts don't provide for, or with a word that makes them suspicious.

    contracts: project_id, text. A fee is provided for if a word of its description of more than three letters stands anywhere in a
    contract's text of the project. Fee words and modifiers count anywhere in the description. 0.8, 0.05 more over 1000, 0.1 more with a
    modifier; at most 0.95.

    Words of items are joined with contracts by project; a contract's text is sent to its project's items once for each distinct word.
    """
    low = F.lower("description")
    f = items.filter((F.col("amount") > least) & low.rlike("|".join(FEES)))
    words = f.select("project_id", F.explode(F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3))).alias("word")).distinct()
    said = words.join(contracts.select("project_id", F.lower("text").alias("text")), "project_id").filter(F.contains("text", "word")).select("project_id", "word").distinct()
    each = f.select("item_id", "doc_id", "project_id", F.explode_outer(F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3))).alias("word"))
    known = each.join(said, ["project_id", "word"], "left_semi").select("item_id", "doc_id", F.lit(True).alias("authorised")).distinct()
    j = f.join(known, ["item_id", "doc_id"], "left").withColumns({"authorised": F.coalesce("authorised", F.lit(False)), "modified": low.rlike("|".join(MODIFIERS))})
    confidence = F.least(F.lit(0.95), 0.8 + F.when(F.col("amount") > 1000, 0.05).otherwise(0.0) + F.when(F.col("modified"), 0.1).otherwise(0.0))
    return j.filter("modified OR NOT authorised").select("item_id", "doc_id", "project_id", "authorised", "modified", confidence.alias("confidence"))


def excessive_markups(orders: DataFrame, authorised: DataFrame | None = None) -> DataFrame:
    """project_id, doc_id, markup, allowed, hidden, confidence of change orders (project_id, doc_id, markup in percent, base) whose markup is over 1.2 times what the project's contract allows (project_id, allowed; AUTHORISED without one).

    hidden: the base times what exceeds the allowed; confidence 0.7 + a tenth of the excess points, at most 0.95. Orders without a base are not flagged.
    """
    j = orders.withColumn("allowed", F.lit(AUTHORISED)) if authorised is None else orders.join(authorised.groupBy("project_id").agg(F.max("allowed").alias("allowed")), "project_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(AUTHORISED)))
    over = F.col("markup") - F.col("allowed")
    j = j.filter((F.col("markup") > F.col("allowed") * EXCESS) & (F.col("base") != 0))
    return j.select("project_id", "doc_id", "markup", "allowed", (F.col("base") * over / 100).alias("hidden"), F.least(F.lit(0.95), 0.7 + over / 10).alias("confidence"))


def holiday_share(documents: DataFrame, first: int, last: int, least: int = 10, factor: float = 1.5) -> DataFrame:
    """One row of documents dated in years first to last, if there are `least`: how many are dated on a US holiday or a day beside it, how many to expect, and whether there are over `factor` times as many.

    Expected is the documents times the share of the days of those years that are such days.
    """
    days = holidays(documents.sparkSession, first, last).select(F.explode(F.array(F.date_sub("day", 1), "day", F.date_add("day", 1))).alias("date_created")).distinct()
    days = days.filter(F.year("date_created").between(first, last))
    length = sum(366 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 365 for y in range(first, last + 1))
    d = documents.filter(F.year("date_created").between(first, last)).groupBy("date_created").agg(F.count(F.lit(1)).alias("n"))
    g = d.join(days.withColumn("beside", F.lit(1)), "date_created", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("beside") == 1, F.col("n"))), F.lit(0)).alias("beside"))
    g = g.crossJoin(days.agg(F.count(F.lit(1)).alias("days"))).filter(F.col("documents") >= least)  # one row each
    expected = F.col("documents") * F.col("days") / length
    return g.select("documents", "beside", expected.alias("expected"), (F.col("beside") > factor * expected).alias("unusual"))


def amount_outliers(items: DataFrame, by: tuple[str, ...] = ("cost_code", "doc_type", "party"), least: int = 5) -> DataFrame:
    """item_id, doc_id, methods, confidence: items whose amount is an outlier of their group by standard score, by quartiles, or both.

    Confidence by standard score is that of zscore_outliers, 0.1 more if quartiles agree; by quartiles alone 0.7 and a fifth of how far
    the amount lies beyond its quartile in distances of the quartiles, less 1.5; at most 0.95. Null groups are called unknown.
    """
    from tallyforge.operators.sequences import iqr_outliers, zscore_outliers

    rows = items.select("item_id", "doc_id", F.col("amount").cast("double").alias("v"), *(F.coalesce(c, F.lit("unknown")).alias(c) for c in by)).filter("v IS NOT NULL")
    z = zscore_outliers(rows, "v", by, least=least).select("item_id", "doc_id", F.lit("z_score").alias("method"), F.col("confidence").alias("c"))
    far = F.when(F.col("v") > F.col("q3"), (F.col("v") - F.col("q3")) / F.col("iqr")).otherwise((F.col("q1") - F.col("v")) / F.col("iqr")) - 1.5
    q = iqr_outliers(rows, "v", by, "item_id", least=least).select("item_id", "doc_id", F.lit("iqr").alias("method"), F.least(F.lit(0.95), 0.7 + 0.2 * far).alias("c"))
    g = z.unionByName(q).groupBy("item_id", "doc_id").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.max(F.when(F.col("method") == "z_score", F.col("c"))).alias("z"), F.max(F.when(F.col("method") == "iqr", F.col("c"))).alias("q"))
    return g.select("item_id", "doc_id", "methods", F.coalesce(F.least(F.lit(0.95), F.col("z") + F.when(F.col("q").isNotNull(), 0.1).otherwise(0.0)), "q").alias("confidence"))
