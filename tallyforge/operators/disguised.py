"""Amounts in disguise: pairs that differ by rounding, a fee, tax or discount; rejected amounts that come back in parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents
from tallyforge.functions.texts import word_set
from tallyforge.storage import stored

#: Units of rounding in dollars; fee ratios in hundredths; factors of tax and of discount in ten-thousandths (fixed values).
ROUNDED_TO = (1, 5, 10, 25, 50, 100)
FEE_RATIOS = (105, 115)
TAXED, DISCOUNTED = (10700, 10800, 10925), (9000, 9500, 9250)
#: Descriptions that an amount brings along into its pairs; for amounts with more, the rest is joined.
TEXTS = 8
#: Names of the rules, in the order in which a pair takes the first that holds.
RULES = (*(f"rounded_{u}" for u in ROUNDED_TO), "fee", "tax", "discount", "near")


def half_even(c: Column, unit: int) -> Column:
    """Cents to a multiple of unit dollars, halves to the even multiple."""
    u = unit * 100
    q, r = F.floor(c / u), F.pmod(c, F.lit(u))
    return (q + F.when(2 * r > u, 1).when(2 * r < u, 0).otherwise(F.pmod(q, F.lit(2)))) * u


def _related(amounts: DataFrame, more: tuple[str, ...] = (), percent: int = 5, most: float = 1000.0) -> DataFrame:
    """project_id, a, b, rule, and columns `more` of either as a_... and b_...: each two of a project's amounts (project_id, cents: distinct rows) that a rule relates.

    Whatever the rule, amounts from 334 dollars on are within 15 % of each other (or what `percent` of the mean allows), and lower ones
    within 15 % of 334. Bins are that wide, evenly below and by logarithm above, so the greater of two lies in the smaller's bin or the
    next: an equality join in which each pair comes once, in order, and both ways round are tested on it.
    """
    s = amounts.select("project_id", F.signum("cents").cast("int").alias("sign"), F.abs("cents").alias("c"), *more).filter("c > 0")
    low = 33_400
    wide = max(0.15, (200 + percent) / (200 - percent) - 1 + 1e-6)
    c = F.col("c").cast("double")
    at = F.floor(F.when(c < low, c / (wide * low)).otherwise((1 + F.log(c / low)) / wide)).cast("long")
    # Of which units an amount is a multiple (bits from 0), and an even one (from 8): what others may be rounded to.
    whole = reduce(lambda m, b: m + b, (F.when(F.col("c") % (u * 100 * n) == 0, 1 << k + at).otherwise(0) for k, u in enumerate(ROUNDED_TO) for n, at in ((1, 0), (2, 8))))
    s = s.withColumns({"m": F.when(F.col("c") % 100 == 0, whole).otherwise(0), "bin": at})
    x = s.select("project_id", "sign", F.col("c").alias("x"), F.col("m").alias("xm"), *(F.col(k).alias(f"x_{k}") for k in more), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    y = s.select("project_id", "sign", F.col("c").alias("y"), F.col("m").alias("ym"), *(F.col(k).alias(f"y_{k}") for k in more), "bin")
    p, q, d = F.col("x"), F.col("y"), F.col("y") - F.col("x")
    # The fewest comparisons first: the exact tests are a long expression.
    j = x.join(y, ["project_id", "sign", "bin"]).filter((p < q) & ((100 * q <= FEE_RATIOS[1] * p) | (d <= ROUNDED_TO[-1] * 50) | (d * 200 <= percent * (p + q))))
    j = j.withColumn("m", F.col("xm").bitwiseOR(F.col("ym")))
    round_to = reduce(lambda out, k: F.when(((d < ROUNDED_TO[k] * 50) & (F.col("m").bitwiseAND(1 << k) != 0)) | ((d == ROUNDED_TO[k] * 50) & (F.col("m").bitwiseAND(1 << k + 8) != 0)), F.lit(k)).otherwise(out), reversed(range(len(ROUNDED_TO))), F.lit(None).cast("int"))
    n = len(ROUNDED_TO)
    rate = lambda group: reduce(lambda a, b: a | b, ((F.abs(p * f - q * 10000) < 500_000) | (F.abs(q * f - p * 10000) < 500_000) for f in group))
    fee = (100 * q >= FEE_RATIOS[0] * p) & (100 * q <= FEE_RATIOS[1] * p)
    near = (d * 200 <= percent * (p + q)) & (d <= round(most * 100))
    j = j.withColumn("at", F.coalesce(F.when(F.col("m") != 0, round_to), F.when(fee, n).when(rate(TAXED), n + 1).when(rate(DISCOUNTED), n + 2).when(near, n + 3)))
    j = j.withColumn("rule", F.explode(F.when(F.col("at").isNotNull(), F.array(F.element_at(F.array(*(F.lit(r) for r in RULES)), F.col("at") + 1)))))
    up = F.col("sign") > 0
    sides = [c for m in more for c in (F.when(up, F.col(f"x_{m}")).otherwise(F.col(f"y_{m}")).alias(f"a_{m}"), F.when(up, F.col(f"y_{m}")).otherwise(F.col(f"x_{m}")).alias(f"b_{m}"))]
    return j.select("project_id", F.when(up, p).otherwise(-q).alias("a"), F.when(up, q).otherwise(-p).alias("b"), "rule", *sides)


def disguised_pairs(amounts: DataFrame, percent: int = 5, most: float = 1000.0) -> DataFrame:
    """project_id, a, b, rule: each two different amounts (cents, a < b) of a project's rows (project_id, cents) that a rule relates; of several the first of RULES.

    One is the other rounded to a unit; greater by a fee of 5 to 15 %; within 0.50 of the other with a tax or discount rate; or they are
    within `percent` of their mean and `most` apart. Amounts of either sign are compared with their like, zero with nothing.
    """
    return _related(amounts.select("project_id", "cents").distinct(), (), percent, most)


def fuzzy_items(items: DataFrame, overlap: float = 0.3) -> DataFrame:
    """project_id, a, b, rule, differ, alike, confidence: disguised pairs of line items' amounts; 0.7, 0.1 more if their document types differ, 0.15 more if two of their descriptions share over `overlap` of the words of the shorter.

    An amount brings its descriptions along up to TEXTS; for pairs of an amount with more, and none alike so far, they are joined row by row.
    """
    rows = items.select("project_id", cents(F.col("amount")).alias("cents"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.array_distinct(F.filter(F.split(F.lower("description"), r"\s+"), lambda w: w != "")).alias("w"))
    types = rows.groupBy("project_id", "cents").agg(F.array_sort(F.collect_set("doc_type")).alias("types"))  # a few types
    texts = rows.filter(F.size("w") > 0).select("project_id", "cents", "w").distinct()
    some = texts.withColumn("_k", F.row_number().over(Window.partitionBy("project_id", "cents").orderBy("w"))).filter(F.col("_k") <= TEXTS + 1)
    some = some.groupBy("project_id", "cents").agg(F.collect_list("w").alias("texts"))
    amounts = stored(types.join(some, ["project_id", "cents"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<array<string>>"))), "amounts")
    like = lambda u, v: F.size(F.array_intersect(u, v)) / F.least(F.size(u), F.size(v)) > overlap
    pairs = _related(amounts, ("types", "texts"))
    pairs = pairs.withColumn("alike", F.exists("a_texts", lambda u: F.exists("b_texts", lambda v: like(u, v)))).withColumn("differ", F.col("a_types") != F.col("b_types"))
    if amounts.filter(F.size("texts") > TEXTS).limit(1).count():
        open_ = pairs.filter(~F.col("alike") & (F.greatest(F.size("a_texts"), F.size("b_texts")) > TEXTS)).select("project_id", "a", "b")
        for side in ("a", "b"):
            open_ = open_.join(texts.select("project_id", F.col("cents").alias(side), F.col("w").alias(f"w{side}")), ["project_id", side])
        also = open_.filter(like(F.col("wa"), F.col("wb"))).select("project_id", "a", "b", F.lit(True).alias("also")).distinct()
        pairs = pairs.join(also, ["project_id", "a", "b"], "left").withColumn("alike", F.col("alike") | F.coalesce("also", F.lit(False)))
    confidence = 0.7 + F.when(F.col("differ"), 0.1).otherwise(0.0) + F.when(F.col("alike"), 0.15).otherwise(0.0)
    return pairs.select("project_id", "a", "b", "rule", "differ", "alike", confidence.alias("confidence"))


def fuzzy_documents(documents: DataFrame) -> DataFrame:
    """project_id, a, b, rule, differ, rejected, confidence: disguised pairs of documents' totals; 0.75, 0.1 more if their types differ, 0.15 more if a document of either is rejected."""
    rows = documents.select("project_id", cents(F.col("total")).alias("cents"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce(F.lower("status").contains("reject"), F.lit(False)).alias("rejected"))
    amounts = rows.groupBy("project_id", "cents").agg(F.array_sort(F.collect_set("doc_type")).alias("types"), F.max("rejected").alias("bad"))  # a few types
    out = _related(amounts, ("types", "bad")).withColumns({"differ": F.col("a_types") != F.col("b_types"), "rejected": F.col("a_bad") | F.col("b_bad")})
    return out.withColumn("confidence", 0.75 + F.when(F.col("differ"), 0.1).otherwise(0.0) + F.when(F.col("rejected"), 0.15).otherwise(0.0)).drop("a_types", "b_types", "a_bad", "b_bad")


def fuzzy_summary(items: DataFrame, documents: DataFrame) -> DataFrame:
    """project_id, item_pairs, document_pairs, confidence: what a project has of either, 0.7 + 0.05 a pair, at most 0.95."""
    a = disguised_pairs(items.select("project_id", cents(F.col("amount")).alias("cents"))).select("project_id", F.lit(1).alias("i"), F.lit(0).alias("d"))
    b = disguised_pairs(documents.select("project_id", cents(F.col("total")).alias("cents"))).select("project_id", F.lit(0).alias("i"), F.lit(1).alias("d"))
    g = a.unionByName(b).groupBy("project_id").agg(F.sum("i").alias("item_pairs"), F.sum("d").alias("document_pairs"))
    return g.withColumn("confidence", F.least(F.lit(0.95), 0.7 + 0.05 * (F.col("item_pairs") + F.col("document_pairs"))))


def split_rejections(documents: DataFrame, least: float = 10_000.0, most: float = 5_000.0, per_mille: int = 50, parts: int = 5, terms: DataFrame | None = None) -> DataFrame:
    """project_id, rejected_id, whole, parts (ids in order), n, sum_cents, shared, confidence: rejected change orders over `least`, and every set of one to `parts` (at most 5) other change orders of the project under `most` each whose sum is within per_mille of it.

    terms (doc_id, terms: an array) names what a document is about; shared is how many of the rejected one's terms the parts have, and
    adds 0.05 each to a confidence of 0.8. Amounts that are not positive are no parts. Rejected orders may be parts of others.

    Sets meet in the middle: sums of one, two and three parts by ascending ids; four are two and two, five are two and three, joined on
    what is missing from the whole, in bins of the power of two above the tolerance, with the ids of the one below those of the other.
    Sums are written to the shared folder, as several joins read them.
    """
    if not 1 <= parts <= 5:
        raise ValueError("parts: 1 to 5")
    orders = documents.filter("doc_type = 'change_order'")
    bad = reduce(lambda a, b: a | b, (F.lower("status").contains(w) for w in ("reject", "denied", "decline")))
    r = orders.filter(bad & (F.col("total") > least)).select("project_id", F.col("doc_id").alias("rejected_id"), cents(F.col("total")).alias("whole"))
    off = F.col("whole") * per_mille / 1000
    r = r.withColumns({"low": F.ceil(F.col("whole") - off), "high": F.floor(F.col("whole") + off), "level": F.ceil(F.log2(F.greatest(2 * off, F.lit(1.0)))).cast("int")})
    r = stored(r, "rejected")
    top = r.groupBy("project_id").agg(F.max("high").alias("top"))
    one = orders.filter((F.col("total") < most) & (F.col("total") > 0)).select("project_id", "doc_id", cents(F.col("total")).alias("c")).join(top, "project_id").filter("c <= top")
    one = stored(one, "orders")
    sums = [one.select("project_id", "top", F.array("doc_id").alias("ids"), F.col("doc_id").alias("first"), F.col("doc_id").alias("last"), F.col("c").alias("s"))]
    for _ in range(min(parts, 3) - 1):
        more = sums[-1].join(one.select("project_id", "doc_id", "c"), "project_id").filter("doc_id > last AND s + c <= top")
        sums.append(stored(more.select("project_id", "top", F.concat("ids", F.array("doc_id")).alias("ids"), "first", F.col("doc_id").alias("last"), (F.col("s") + F.col("c")).alias("s")), "sums"))
    levels = r.select("project_id", "level").distinct()
    placed = [x.join(levels, "project_id").withColumn("bin", F.expr("shiftright(s, level)")) for x in sums]
    bins = lambda low, high: F.explode(F.sequence(F.expr(f"shiftright({low}, level)"), F.expr(f"shiftright({high}, level)")))
    found = [r.withColumn("bin", bins("low", "high")).join(x, ["project_id", "level", "bin"]).filter("s BETWEEN low AND high AND NOT array_contains(ids, rejected_id)") for x in placed]
    found = [x.select("project_id", "rejected_id", "whole", "ids", "s") for x in found]
    if parts >= 4:
        head = r.join(sums[1].select("project_id", F.col("ids").alias("head"), F.col("last").alias("end"), F.col("s").alias("hs")), "project_id").filter("hs < high AND NOT array_contains(head, rejected_id)")
        head = head.withColumn("bin", bins("greatest(low - hs, 0)", "high - hs"))
        for x in placed[1 : parts - 2]:
            j = head.join(x, ["project_id", "level", "bin"]).filter("first > end AND hs + s BETWEEN low AND high AND NOT array_contains(ids, rejected_id)")
            found.append(j.select("project_id", "rejected_id", "whole", F.concat("head", "ids").alias("ids"), (F.col("hs") + F.col("s")).alias("s")))
    out = reduce(DataFrame.unionByName, found).select("project_id", "rejected_id", "whole", F.col("ids").alias("parts"), F.size("ids").cast("long").alias("n"), F.col("s").alias("sum_cents"))
    if terms is None:
        return out.withColumns({"shared": F.lit(0).cast("long"), "confidence": F.lit(0.8)})
    out = stored(out, "sets")
    # Of the documents in sets alone; that is written, as it is read for either side.
    asked = out.select(F.explode(F.concat(F.array("rejected_id"), "parts")).alias("doc_id")).distinct()
    terms = stored(terms.select("doc_id", "terms").join(asked, "doc_id", "left_semi"), "terms")
    each = out.select("rejected_id", "parts", F.explode("parts").alias("doc_id")).join(terms.select("doc_id", F.explode("terms").alias("term")), "doc_id")
    own = terms.select(F.col("doc_id").alias("rejected_id"), F.explode("terms").alias("term")).distinct()
    shared = each.select("rejected_id", "parts", "term").distinct().join(own, ["rejected_id", "term"]).groupBy("rejected_id", "parts").agg(F.count(F.lit(1)).alias("shared"))
    out = out.join(shared, ["rejected_id", "parts"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    return out.withColumn("confidence", 0.8 + 0.05 * F.col("shared"))


def description_terms(items: DataFrame) -> DataFrame:
    """doc_id, terms: the words of a document's line items."""
    return items.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(word_set(F.col("description"))))).alias("terms"))
