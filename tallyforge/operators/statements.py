"""What items and documents state, against what their other figures say: eight checks, and who benefits. Chains of change orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents
from tallyforge.functions.json import number_in
from tallyforge.operators.components import components
from tallyforge.operators.splits import percent_complete

#: Figures of a document that are the sum of its items (fixed values).
SUMS = ("completed_to_date", "total_completed_and_stored", "total_completed")
#: Of each check: least difference in dollars, least share of the larger figure, confidence, confidence if it benefits who submits, and the types of document where it can.
BILLS, ALL = ("invoice", "payment_app"), ("invoice", "payment_app", "change_order")
CHECKS = {
    "quantity_price": (0.01, 0.0, 0.95, 0.98, ALL), "amount_total": (0.01, 0.0, 0.90, 0.95, ALL), "percent_complete": (0.1, 0.01, 0.90, 0.95, BILLS), "current_work": (0.1, 0.01, 0.90, 0.95, ("payment_app",)),
    "category_total": (0.01, 0.01, 0.90, 0.95, ALL), "document_total": (0.01, 0.01, 0.95, 0.98, ALL), "retainage": (0.01, 0.01, 0.95, 0.98, ("payment_app",)), "payment_due": (0.01, 0.01, 0.95, 0.98, ("payment_app",)),
}


def _wrong(check: str, stated: Column, expected: Column) -> Column:
    """Whether figures differ by more than a check's least difference and share."""
    off, larger = F.abs(stated - expected), F.greatest(F.abs(stated), F.abs(expected))
    # A tenth of a cent is left for figures that are whole cents.
    return (off > CHECKS[check][0] + 0.001) & (F.coalesce(F.try_divide(off, larger), F.lit(0.0)) > CHECKS[check][1])


def _row(check: str, item, stated: Column, expected: Column) -> Column:
    """A row of a check, null where its figures agree or one is missing."""
    stated, expected = stated.cast("double"), expected.cast("double")
    return F.when(_wrong(check, stated, expected), F.struct(F.lit(check).alias("check"), (F.col(item) if item else F.lit(None)).cast("string").alias("item_id"), F.lit(None).cast("string").alias("part"), stated.alias("stated"), expected.alias("expected")))


def statement_errors(items: DataFrame, documents: DataFrame, submitter: str = "contractor") -> DataFrame:
    """check, doc_id, item_id, part, stated, expected, benefits, confidence of each figure that its others contradict.

    Of items (doc_id, item_id, amount, quantity, unit_price, total, category, meta_data): quantity_price (total against quantity times
    price), amount_total (amount against total), percent_complete (amount against that share of scheduled_value), current_work (amount
    against total less previous_completed, in payment applications). Of documents (doc_id, doc_type, party, meta_data): category_total
    (each of category_totals against the items of that category; part names it), document_total (completed_to_date and the like against
    all items; part names it), retainage (against retainage_percent of completed_to_date; over 1 is percent), payment_due (against
    total_earned_less_retainage less previous_certificates). meta_data is JSON; a figure that is missing or no number is not compared.

    benefits: it is the submitter's document of a type that bills, and states more than it should (less retainage). Least differences and
    confidences are those of CHECKS; shares are of the larger figure.
    """
    at = lambda name: number_in(F.col("parsed"), name)
    has_total = "total" in items.columns
    i = items.select("doc_id", "item_id", *(F.col(c).cast("double").alias(c) for c in ("amount", "quantity", "unit_price")), (F.col("total") if has_total else F.lit(None)).cast("double").alias("total"), (F.col("meta_data") if "meta_data" in items.columns else F.lit(None)).cast("string").alias("meta_data"))
    i = i.withColumn("parsed", F.try_parse_json("meta_data"))
    figures = i.select("doc_id", "item_id", "amount", "quantity", "unit_price", "total", percent_complete(F.col("meta_data"), F.col("parsed")).alias("share"), at("scheduled_value").alias("scheduled"), at("previous_completed").alias("previous"))
    of_items = F.array(
        _row("quantity_price", "item_id", F.col("total"), F.col("quantity") * F.col("unit_price")), _row("amount_total", "item_id", F.col("amount"), F.col("total")),
        _row("percent_complete", "item_id", F.col("amount"), F.col("share") * F.col("scheduled")), _row("current_work", "item_id", F.col("amount"), F.col("total") - F.col("previous")),
    )
    # Documents are joined before rows are put together, so items that come by document need no further shuffle.
    who = documents.select("doc_id", "doc_type", "party")
    out = figures.join(who, "doc_id").select("doc_id", "doc_type", "party", F.explode(of_items).alias("r")).filter("r IS NOT NULL").select("doc_id", "doc_type", "party", "r.*")

    d = documents.filter("meta_data IS NOT NULL").select("doc_id", "doc_type", "party", "meta_data", F.try_parse_json("meta_data").alias("parsed"))
    # Sums in whole cents, so they are exact.
    by_both = items.groupBy("doc_id", "category").agg(F.sum(cents(F.col("amount"))).alias("c"))
    sums = by_both.groupBy("doc_id").agg((F.sum("c") / 100).alias("sum"))
    by_category = by_both.filter("category IS NOT NULL AND category != ''").select("doc_id", "category", (F.col("c") / 100).alias("sum"))
    of_documents = ("doc_id", "doc_type", "party")
    row = lambda check, part: (*of_documents, F.lit(check).alias("check"), F.lit(None).cast("string").alias("item_id"), part, "stated", F.col("sum").alias("expected"))
    named = d.select(*of_documents, F.explode(F.from_json(F.get_json_object("meta_data", "$.category_totals"), "map<string,string>")).alias("category", "said"))
    c = named.withColumn("stated", F.col("said").try_cast("double")).join(by_category, ["doc_id", "category"]).filter(_wrong("category_total", F.col("stated"), F.col("sum")))
    out = out.unionByName(c.select(*row("category_total", F.col("category").alias("part"))))
    stated = F.explode(F.array(*(F.struct(F.lit(name).alias("part"), at(name).alias("stated")) for name in SUMS)))
    t = d.select(*of_documents, stated.alias("x")).select(*of_documents, "x.*").filter("stated IS NOT NULL").join(sums, "doc_id").filter(_wrong("document_total", F.col("stated"), F.col("sum")))
    out = out.unionByName(t.select(*row("document_total", "part")))
    f = d.select(*of_documents, *(at(name).alias(name) for name in ("retainage", "retainage_percent", "completed_to_date", "current_payment_due", "total_earned_less_retainage", "previous_certificates")))
    rate = F.col("retainage_percent")
    both = F.array(
        _row("retainage", None, F.col("retainage"), F.col("completed_to_date") * F.when(rate > 1, rate / 100).otherwise(rate)),
        _row("payment_due", None, F.col("current_payment_due"), F.col("total_earned_less_retainage") - F.col("previous_certificates")),
    )
    out = out.unionByName(f.select(*of_documents, F.explode(both).alias("r")).filter("r IS NOT NULL").select(*of_documents, "r.*"))

    of = lambda k: reduce(lambda x, n: F.when(F.col("check") == n, F.lit(CHECKS[n][k])).otherwise(x), CHECKS, F.lit(None).cast("double"))
    j = out.filter((F.col("check") != "current_work") | (F.col("doc_type") == "payment_app"))
    bills = reduce(lambda x, n: F.when(F.col("check") == n, F.col("doc_type").isin(*CHECKS[n][4])).otherwise(x), CHECKS, F.lit(False))
    more = F.when(F.col("check") == "retainage", F.col("stated") < F.col("expected")).otherwise(F.col("stated") > F.col("expected"))
    j = j.withColumn("benefits", F.coalesce(bills & (F.col("party") == submitter) & more, F.lit(False)))
    return j.select("check", "doc_id", "item_id", "part", "stated", "expected", "benefits", F.when(F.col("benefits"), of(3)).otherwise(of(2)).alias("confidence"), "party")


def systematic_errors(errors: DataFrame, least: int = 3) -> DataFrame:
    """party, n, confidence: parties that `least` or more of statement_errors() benefit; 0.75 + 0.05 each, at most 0.95."""
    g = errors.filter("benefits").groupBy("party").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return g.withColumn("confidence", F.least(F.lit(0.95), 0.75 + 0.05 * F.col("n")))


def order_chains(relationships: DataFrame, documents: DataFrame, least: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """first, orders (in order of date, then id), n, sum_cents, confidence (0.9): chains of `least` or more change orders that are each in sequence with the next.

    Of an order's sequences the one to the smallest id counts, and of those that lead to an order the one from the smallest id; so chains
    don't branch. A circle of sequences is a chain too.
    """
    co = documents.filter("doc_type = 'change_order'").select("doc_id", "date_created", cents(F.col("total")).alias("c"))
    s = relationships.filter((F.col("relationship_type") == "sequential") & (F.col("confidence") >= min_confidence)).select(F.col("source_doc_id").alias("a"), F.col("target_doc_id").alias("b")).filter("a != b")
    s = s.join(co.select(F.col("doc_id").alias("a")), "a", "left_semi").join(co.select(F.col("doc_id").alias("b")), "b", "left_semi")
    s = s.groupBy("a").agg(F.min("b").alias("b")).groupBy("b").agg(F.min("a").alias("a"))
    parts = components(s.select("a", "b"))
    sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rows = parts.join(sizes, "root").join(co, F.col("id") == F.col("doc_id"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("date_created", "doc_id"))
    g = rows.withColumn("k", place).groupBy("root", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"]).alias("orders"), F.sum("c").alias("sum_cents"))
    return g.select(F.element_at("orders", 1).alias("first"), "orders", "n", "sum_cents", F.lit(0.9).alias("confidence"))
