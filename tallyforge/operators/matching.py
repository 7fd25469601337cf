"""Matches between amounts: exact, fuzzy, by rate, rounded, split, combined and in context.

Self-joins on amounts go through logarithmic bins, an equality join, and then the exact test; never a plain range join. Where all pairs
of a whole table would grow with its square they are taken within a project, or amounts are grouped before they are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import ITEM_MARKUPS, MARKUP_RATES, TAX_RATES, cents, near_bin, split_rates
from tallyforge.functions.texts import jaccard, word_set


def _near(items: DataFrame, amount: float, per_mille: int) -> DataFrame:
    c = round(amount * 100)
    return items.filter((F.abs(cents(F.col("amount")) - c) * 1000 <= per_mille * c) & (F.col("amount") > 0))


def exact_matches(items: DataFrame, amount: float, per_mille: int = 10) -> DataFrame:
    """Relative tolerance; 0 means a cent. In order of date, then id."""
    c = round(amount * 100)
    found = _near(items, amount, per_mille) if per_mille else items.filter(F.abs(cents(F.col("amount")) - c) <= 1)
    return found.orderBy("date_created", "item_id")


def matches_in_date_range(items: DataFrame, amount: float, start: str, end: str, tolerance_cents: int = 1) -> DataFrame:
    """Absolute tolerance, and dated in the range."""
    return items.filter((F.abs(cents(F.col("amount")) - round(amount * 100)) <= tolerance_cents) & F.col("date_created").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def item_matches(items: DataFrame, per_mille: int = 10, within: str = "project_id") -> DataFrame:
    """For each pair of items of different documents, in the same group, whose amounts differ by at most per_mille thousandths of the first's: ids and difference in cents.

    An equality join on (group, bin) in which each two meet once, as the greater amount lies in the smaller's bin or the next; then the
    exact test, either way round. What holds for the smaller as the first also holds for the greater.
    """
    base = items.filter("amount > 0").select(within, "item_id", "doc_id", "date_created", cents(F.col("amount")).alias("c"))
    base = base.withColumn("bin", near_bin(F.col("c"), per_mille))  # of the cents, so bins are in their order
    columns = ("item_id", "doc_id", "date_created", "c")
    x = base.select(within, *(F.col(k).alias("x_" + k) for k in columns), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    y = base.select(within, *(F.col(k).alias("y_" + k) for k in columns), "bin")
    off = (F.col("y_c") - F.col("x_c")) * 1000
    once = (F.col("x_doc_id") != F.col("y_doc_id")) & ((off > 0) | ((off == 0) & (F.col("x_doc_id") < F.col("y_doc_id"))))
    j = x.join(y, [within, "bin"]).filter(once & (off <= per_mille * F.col("y_c")))
    j = j.withColumn("_up", F.explode(F.when(off <= per_mille * F.col("x_c"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    end = lambda k, one, other: F.when(F.col("_up"), F.col(one + k)).otherwise(F.col(other + k))
    return j.select(within, *(end(k, "x_", "y_").alias("a_" + k) for k in columns), *(end(k, "y_", "x_").alias("b_" + k) for k in columns))


def matches_between_documents(items: DataFrame, left, right, per_mille: int = 50) -> DataFrame:
    """Per item of one document: the other's items with about its amount, closest first."""
    both = items.filter(F.col("doc_id").isin(left, right)).withColumn("_pair", F.lit(1))
    pairs = item_matches(both, per_mille, "_pair").filter(F.col("a_doc_id") == left)
    near = F.array_sort(F.collect_list(F.struct(F.abs(F.col("a_c") - F.col("b_c")).alias("off"), F.col("b_item_id").alias("item_id"))))
    return pairs.groupBy(F.col("a_item_id").alias("item_id")).agg(near.alias("matches"))


def fuzzy_matches(items: DataFrame, amount: float, per_mille: int = 100) -> DataFrame:
    """Items within the threshold; confidence falls from 1 to 0 with the difference."""
    c = round(amount * 100)
    off = F.abs(cents(F.col("amount")) - c)
    return _near(items, amount, per_mille).withColumn("confidence", 1 - off * 1000.0 / (per_mille * c))


def rate_matches(items: DataFrame, amount: float, rates: tuple[float, ...], up: str, down: str) -> DataFrame:
    """Items within 1 % of amount * (1 + r) (`up`) or amount / (1 + r) (`down`), for each rate; confidence 1 at no difference."""
    both = F.array(F.struct(F.lit(up).alias("direction"), (F.lit(float(amount)) * (1 + F.col("rate"))).alias("adjusted")), F.struct(F.lit(down).alias("direction"), (F.lit(float(amount)) / (1 + F.col("rate"))).alias("adjusted")))
    r = items.select("item_id", "doc_id", "amount", F.explode(split_rates(rates)).alias("rate")).withColumn("t", F.explode(both)).select("item_id", "doc_id", "amount", "rate", "t.*")
    off = F.abs(F.col("amount").cast("double") - F.col("adjusted")) / F.col("adjusted")
    return r.withColumn("off", off).filter("off <= 0.01").withColumn("confidence", 1 - F.col("off") / 0.01)


def markup_matches(items: DataFrame, amount: float, rates: tuple[float, ...] = MARKUP_RATES) -> DataFrame:
    return rate_matches(items, amount, rates, "markup", "base")


def tax_matches(items: DataFrame, amount: float, rates: tuple[float, ...] = TAX_RATES) -> DataFrame:
    return rate_matches(items, amount, rates, "with_tax", "pre_tax")


def rounded_matches(items: DataFrame, amount: float) -> DataFrame:
    """Items within 0.1 % of the amount rounded half-even to 1, 10, 100 or 1000, where that changes it by at most 15 %."""
    levels = items.sparkSession.createDataFrame([(n, float(round(amount / n) * n)) for n in (1, 10, 100, 1000) if round(amount / n) * n not in (0, amount) and abs(round(amount / n) * n - amount) <= 0.15 * amount], "level int, rounded double")
    # At most four rows, by construction.
    return items.join(F.broadcast(levels), F.abs(F.col("amount").cast("double") - F.col("rounded")) * 1000 <= F.col("rounded")).select("item_id", "doc_id", "amount", "level", "rounded")


def split_matches(items: DataFrame, amount: float, most: int = 4) -> DataFrame:
    """For 2 to `most` parts: the n items nearest to amount / n within 5 %, where there are n; confidence 0.90, 0.85, 0.80."""
    c = round(amount * 100)
    parts = items.sparkSession.createDataFrame([(n, c / n, 1.0 - 0.05 * n) for n in range(2, most + 1)], "parts int, target double, confidence double")
    off = F.abs(cents(F.col("amount")) - F.col("target"))
    near = items.select("item_id", "doc_id", "amount").join(F.broadcast(parts), off * 20 <= F.col("target")).withColumn("off", off)
    w = Window.partitionBy("parts").orderBy("off", "item_id")
    top = near.withColumn("k", F.row_number().over(w)).filter("k <= parts")  # the window keeps a part's best n before it sorts more
    return top.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("parts"))).filter("found = parts").select("parts", "k", "item_id", "amount", "confidence")


def combination_matches(items: DataFrame, amount: float) -> DataFrame:
    """The item nearest to an amount within 20 % but not equal, as its partner; and items within 1 % of their sum, with confidence 0.85."""
    c = round(amount * 100)
    off = F.abs(cents(F.col("amount")) - c)
    partner = items.filter((off * 5 <= c) & (off > 0)).orderBy(off, "item_id").limit(1).select(F.col("item_id").alias("partner_id"), (cents(F.col("amount")) + c).alias("s"))
    return items.join(F.broadcast(partner), F.abs(cents(F.col("amount")) - F.col("s")) * 100 <= F.col("s")).select("partner_id", "item_id", "amount", F.lit(0.85).alias("confidence"))


def amount_similarity(a: Column, b: Column) -> Column:
    """1 at equality, 0 from 5 % of the larger on, and where an amount is missing or not positive."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b) / 0.05)).otherwise(0.0)


def context_similarity(amount: Column, description: Column, other_amount: Column, other_description: Column, other_cost_code: Column) -> Column:
    """0.4 amount + 0.3 description (Jaccard) + 0.2 if a token of the other's cost code stands in the description + 0.1 * 0.5 for the document type."""
    mine = word_set(description)
    code = F.when(F.arrays_overlap(mine, word_set(other_cost_code)), 1.0).otherwise(0.0)
    return 0.4 * amount_similarity(amount, other_amount) + 0.3 * jaccard(mine, word_set(other_description)) + 0.2 * code + 0.1 * 0.5


def context_matches(items: DataFrame, amount: float, description: str, threshold: float = 0.6) -> DataFrame:
    """Items within 5 % whose similarity in context reaches the threshold."""
    score = context_similarity(F.lit(float(amount)), F.lit(description), F.col("amount"), F.col("description"), F.col("cost_code"))
    return _near(items, amount, 50).withColumn("similarity", score).filter(F.col("similarity") >= threshold)


def context_matches_between_documents(items: DataFrame, left, right, threshold: float = 0.6) -> DataFrame:
    """Pairs of items of two documents by similarity in context."""
    cols = ("item_id", "amount", "description", "cost_code")
    pick = lambda d, p: items.filter(F.col("doc_id") == d).select(F.lit(1).alias("k"), *(F.col(c).alias(p + c) for c in cols))
    score = context_similarity(F.col("a_amount"), F.col("a_description"), F.col("b_amount"), F.col("b_description"), F.col("b_cost_code"))
    return pick(left, "a_").join(pick(right, "b_"), "k").withColumn("similarity", score).filter(F.col("similarity") >= threshold).drop("k")


def item_relations(items: DataFrame) -> DataFrame:
    """Pairs of items of one document where one's amount is half the other's (component, 0.9) or marked up by a known rate (0.9), within 1 %; the first rule that fits."""
    s = items.filter("amount > 0").select("doc_id", "item_id", cents(F.col("amount")).alias("c"))
    a, b = s.select("doc_id", F.col("item_id").alias("small_id"), F.col("c").alias("small")), s.select("doc_id", F.col("item_id").alias("large_id"), F.col("c").alias("large"))
    pairs = a.join(b, "doc_id").filter("small < large")
    kind = F.lit(None).cast("string")
    for r in reversed(ITEM_MARKUPS):
        part = round(r * 10_000)
        kind = F.when(F.abs(F.col("large") * 10_000 - F.col("small") * (10_000 + part)) * 100 <= F.col("small") * (10_000 + part), F.lit(f"markup {r:g}")).otherwise(kind)
    kind = F.when(F.abs(F.col("large") - 2 * F.col("small")) * 100 <= F.col("large"), "component").otherwise(kind)
    return pairs.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("confidence", F.lit(0.9))


def relation_confidence(source_type: Column, target_type: Column, off_percent: Column, days: Column) -> Column:
    """0.9, 0.8 or 0.7 by amount, with steps for days and for known flows between document types; 0.95 at most."""
    base = F.when(off_percent <= 1, 0.9).when(off_percent <= 5, 0.8).otherwise(0.7)
    when = F.when(days <= 7, 0.1).when(days <= 30, 0.05).when(days <= 90, 0.0).otherwise(-0.1)
    flow = (source_type == "change_order") & (target_type == "payment_app") | (source_type == "invoice") & (target_type == "payment_app") | (source_type == "proposal") & (target_type == "contract")
    return F.least(F.lit(0.95), base + when + F.when(flow, 0.1).when(source_type == target_type, 0.05).otherwise(0.0))


def linked_items(items: DataFrame, per_mille: int = 10) -> DataFrame:
    """Pairs of matching items of a project, from the older document to the newer, at most 365 days apart, with confidence."""
    types = items.select(F.col("doc_id"), "doc_type").distinct()
    pairs = item_matches(items, per_mille).filter(F.datediff("b_date_created", "a_date_created").between(1, 365))
    pairs = pairs.join(types.select(F.col("doc_id").alias("a_doc_id"), F.col("doc_type").alias("a_type")), "a_doc_id").join(types.select(F.col("doc_id").alias("b_doc_id"), F.col("doc_type").alias("b_type")), "b_doc_id")
    off = F.abs(F.col("a_c") - F.col("b_c")) * 100.0 / F.greatest("a_c", "b_c")
    return pairs.withColumn("days", F.datediff("b_date_created", "a_date_created")).withColumn("confidence", relation_confidence(F.col("a_type"), F.col("b_type"), off, F.col("days")))


def shared_item_documents(items: DataFrame, per_mille: int = 10) -> DataFrame:
    """Pairs of documents of a project with at least two matching items; confidence 0.7 and up to 0.25 for their number."""
    n = item_matches(items, per_mille).filter("a_doc_id < b_doc_id").groupBy("project_id", "a_doc_id", "b_doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.filter("n >= 2").withColumn("confidence", F.least(F.lit(0.95), 0.7 + F.least(F.col("n") / 10, F.lit(0.25))))


def amount_history(items: DataFrame, amount: float, per_mille: int = 10) -> DataFrame:
    """Items near an amount by document type and month."""
    return _near(items, amount, per_mille).groupBy("doc_type", F.date_format("date_created", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


def amount_groups(items: DataFrame) -> DataFrame:
    """Within a document: amounts, to the cent, that more than one item has."""
    return items.groupBy("doc_id", "amount").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def context_matches_for_item(items: DataFrame, item_id: str, threshold: float = 0.6) -> DataFrame:
    """Other items within 5 % of an item's amount whose similarity in context to it reaches the threshold."""
    one = items.filter(F.col("item_id") == item_id).select(F.col("amount").alias("_amount"), F.col("description").alias("_text")).limit(1)
    score = context_similarity(F.col("_amount"), F.col("_text"), F.col("amount"), F.col("description"), F.col("cost_code"))
    # One row.
    near = items.filter(F.col("item_id") != item_id).join(F.broadcast(one), (F.abs(cents(F.col("amount")) - cents(F.col("_amount"))) * 1000 <= 50 * cents(F.col("_amount"))) & (F.col("amount") > 0))
    return near.withColumn("similarity", score).filter(F.col("similarity") >= threshold).drop("_amount", "_text")


def amount_chronology(items: DataFrame, amount: float, per_mille: int = 10) -> DataFrame:
    """The runs of document types, and of parties, through which an amount goes in order of date: column, run, value, length, first."""
    near, out = _near(items, amount, per_mille), None
    w = Window.orderBy("date_created", "item_id")  # rows of one amount
    for c in ("doc_type", "party"):
        new = F.when(F.lag(c).over(w).eqNullSafe(F.col(c)) & F.lag("item_id").over(w).isNotNull(), 0).otherwise(1)
        r = near.withColumn("_n", new).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        g = r.groupBy("run").agg(F.min(c).alias("value"), F.count(F.lit(1)).alias("length"), F.min("date_created").alias("first")).select(F.lit(c).alias("column"), "run", "value", "length", "first")
        out = g if out is None else out.unionByName(g)
    return out
