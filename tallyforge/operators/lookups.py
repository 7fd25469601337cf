"""Projections, filters, point lookups and summaries over documents and line items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents, within_abs
from tallyforge.functions.texts import jaccard, snippet, word_set


def _all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def _is(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def search_documents(documents: DataFrame, doc_type=None, party=None, date_start=None, date_end=None, status=None, project_id=None) -> DataFrame:
    """Documents that satisfy every condition given."""
    day = lambda d: F.to_date(F.lit(d))
    return _all(
        documents, _is("doc_type", doc_type), _is("party", party), _is("status", status), _is("project_id", project_id),
        None if date_start is None else F.col("date_created") >= day(date_start), None if date_end is None else F.col("date_created") <= day(date_end),
    )


def search_line_items(items: DataFrame, keyword=None, min_amount=None, max_amount=None, cost_code=None, category=None, item_status=None, doc_id=None, doc_type=None, party=None, amount=None, tolerance=0.01) -> DataFrame:
    """Items (with their documents' columns) that satisfy every condition given; keyword in the description, whatever its case."""
    return _all(
        items, None if keyword is None else F.lower("description").contains(keyword.lower()), None if min_amount is None else F.col("amount") >= min_amount, None if max_amount is None else F.col("amount") <= max_amount,
        _is("cost_code", cost_code), _is("category", category), _is("item_status", item_status), _is("doc_id", doc_id), _is("doc_type", doc_type), _is("party", party), None if amount is None else within_abs(F.col("amount"), amount, tolerance),
    )


def payment_applications_by_period(applications: DataFrame, start: str, end: str) -> DataFrame:
    """Those whose period starts, or ends, between the dates."""
    between = lambda c: F.col(c).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return applications.filter(between("period_start") | between("period_end"))


def document_totals(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with its number of items and their sum, 0 without items."""
    sums = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("item_count"), F.sum("amount").alias("item_total"))
    return documents.join(sums, "doc_id", "left").withColumns({"item_count": F.coalesce("item_count", F.lit(0)), "item_total": F.coalesce("item_total", F.lit(0).cast("decimal(25,2)"))})


def document_metadata(items: DataFrame) -> DataFrame:
    """Count, sum, least, greatest and mean amount of each document's items, and how many are distinct."""
    return items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("item_id").alias("distinct_items"), F.sum("amount").alias("total"), F.min("amount").alias("low"), F.max("amount").alias("high"),
        (F.sum(cents(F.col("amount"))) / F.count(F.lit(1)) / 100).alias("mean"),
    )


def amount_references(items: DataFrame, amount: float, per_mille: int = 10) -> DataFrame:
    """Items within per_mille thousandths of an amount, by document type: how often, in how many documents and projects, first and last date, days between."""
    c = round(amount * 100)
    near = items.filter(F.abs(cents(F.col("amount")) - c) * 1000 <= per_mille * c)
    out = near.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("project_id").alias("projects"), F.min("date_created").alias("first"), F.max("date_created").alias("last"))
    return out.withColumn("days", F.datediff("last", "first"))


def date_range_activity(documents: DataFrame, items: DataFrame, start: str, end: str) -> DataFrame:
    """By type and party, for documents dated in the range: documents, items and their sum. Documents without items count."""
    some = search_documents(documents, date_start=start, date_end=end)
    return document_totals(some, items).groupBy("doc_type", "party").agg(F.count(F.lit(1)).alias("documents"), F.sum("item_count").alias("items"), F.sum("item_total").alias("total"))


def transactions(items: DataFrame, min_amount=None, max_amount=None, item_status=None, limit: int = 50) -> DataFrame:
    """The `limit` latest items that satisfy the conditions, then the largest, then by id."""
    some = search_line_items(items, min_amount=min_amount, max_amount=max_amount, item_status=item_status)
    return some.orderBy(F.desc("date_created"), F.desc("amount"), "item_id").limit(limit)


def transactions_summary(items: DataFrame) -> DataFrame:
    """By item status and year: how many, sum, least and greatest amount."""
    return items.groupBy("item_status", F.year("date_created").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.min("amount").alias("low"), F.max("amount").alias("high"))


def financial_timeline(items: DataFrame) -> DataFrame:
    """Per project and day: items, their sum, and the running total of the project."""
    days = items.groupBy("project_id", "date_created").agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("total"))
    return days.withColumn("running", F.sum("total").over(Window.partitionBy("project_id").orderBy("date_created")))


def find_similar_amounts(items: DataFrame, amount: float, per_mille: int = 1) -> DataFrame:
    """Items within per_mille thousandths, with the signed difference and its percentage."""
    c = round(amount * 100)
    d = cents(F.col("amount")) - c
    return items.filter(F.abs(d) * 1000 <= per_mille * c).withColumns({"difference": (d / 100), "percent": d * 100.0 / c})


def search_content(pages: DataFrame, query: str, text: str = "text", around: int = 100) -> DataFrame:
    """Pages that hold the query, whatever its case, with a snippet around its first occurrence."""
    return pages.filter(F.lower(text).contains(query.lower())).withColumn("snippet", snippet(F.col(text), query, around))


def compare_documents(items: DataFrame, left: int, right: int) -> DataFrame:
    """Pairs of items of two documents whose descriptions are equal or contain each other, or whose amounts are within 1 % of the larger."""
    pick = lambda d, p: items.filter(F.col("doc_id") == d).select(*(F.col(c).alias(p + c) for c in ("item_id", "description", "amount")))
    a, b = F.col("a_amount"), F.col("b_amount")
    same = F.lower("a_description") == F.lower("b_description")
    holds = F.lower("a_description").contains(F.lower("b_description")) | F.lower("b_description").contains(F.lower("a_description"))
    near = F.abs(cents(a) - cents(b)) * 100 <= F.greatest(cents(a), cents(b))
    kind = F.when(same, "same description").when(holds, "contained description").otherwise("similar amount")
    # Two documents' items: a join on a key of one value, as each side is one document.
    return pick(left, "a_").withColumn("k", F.lit(1)).join(pick(right, "b_").withColumn("k", F.lit(1)), "k").filter(same | holds | near).withColumn("kind", kind).drop("k")


def related_documents(documents: DataFrame, relationships: DataFrame, doc_id, relationship_types=None, min_confidence: float = 0.0) -> DataFrame:
    """Documents at the other end of a relationship, with its type and direction. Two equality joins, one for each direction."""
    r = relationships.filter(F.col("confidence") >= min_confidence)
    if relationship_types:
        r = r.filter(F.col("relationship_type").isin(*relationship_types))
    ends = r.filter(F.col("source_doc_id") == doc_id).select(F.col("target_doc_id").alias("doc_id"), "relationship_type", "confidence", F.lit("outgoing").alias("direction"))
    ends = ends.unionByName(r.filter(F.col("target_doc_id") == doc_id).select(F.col("source_doc_id").alias("doc_id"), "relationship_type", "confidence", F.lit("incoming").alias("direction")))
    return documents.join(ends, "doc_id")


#: Words that change data or transactions (fixed values).
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "replace", "commit", "rollback", "savepoint", "begin", "call")


def is_read_only(query: str) -> bool:
    """Whether a statement, without its comments, begins with select or with, and holds no word that changes data, not even in a literal."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", query, flags=re.S).strip().lower()
    return bool(re.match(r"(select|with)\b", bare)) and not re.search(r"\b(" + "|".join(FORBIDDEN) + r")\b", bare)


def run_sql(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """A read-only statement over the session's views, with named parameters."""
    if not is_read_only(query):
        raise ValueError("only read-only statements are allowed")
    return spark.sql(query, args=args)


def description_similarity(items: DataFrame, text: str) -> DataFrame:
    """Distinct descriptions by word overlap with a text."""
    return items.select("description").distinct().withColumn("score", jaccard(word_set(F.col("description")), word_set(F.lit(text))))


def flags_by_type(flags: DataFrame, flag_type: str, min_confidence: float | None = None, status: str | None = None) -> DataFrame:
    """Analysis flags of a type, of enough confidence and with a status where those are asked for; surest first."""
    f = flags.filter(F.col("flag_type") == flag_type)
    f = f if min_confidence is None else f.filter(F.col("confidence") >= min_confidence)
    f = f if status is None else f.filter(F.col("status") == status)
    return f.orderBy(F.desc("confidence"), "flag_id")


def registered_matches(matches: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Registered matches (source_item_id, target_item_id) that touch one of the items (item_id) at either end, each once."""
    ids = item_ids.select("item_id").distinct()
    # Matches are read once: each end takes a mark where it is one of the items.
    end = lambda c, mark: ids.select(F.col("item_id").alias(c), F.lit(True).alias(mark))
    marked = matches.join(end("source_item_id", "_s"), "source_item_id", "left").join(end("target_item_id", "_t"), "target_item_id", "left")
    return marked.filter("_s OR _t").select(*matches.columns)


def known_matches(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Registered matches whose two items are a pair of found (a_item_id, b_item_id), in either order."""
    f = found.select(F.least("a_item_id", "b_item_id").alias("x"), F.greatest("a_item_id", "b_item_id").alias("y")).distinct()
    return matches.join(f, (F.least("source_item_id", "target_item_id") == f["x"]) & (F.greatest("source_item_id", "target_item_id") == f["y"]), "left_semi")


def document_by_id(documents: DataFrame, items: DataFrame, doc_id) -> DataFrame:
    """A document with its items as an array in order of their numbers."""
    i = items.filter(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_number", "item_id", "description", "amount"))).alias("items"))
    return documents.filter(F.col("doc_id") == doc_id).join(i, "doc_id", "left")


def document_content(documents: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and text of every document: its pages in order, joined by blank lines; without pages, its type, party and file name and its items' descriptions."""
    p = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "content"))), lambda x: x["content"]), "\n\n").alias("pages"))
    i = items.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_number", "description"))), lambda x: x["description"]), " ").alias("names"))
    rest = F.concat_ws(" ", "doc_type", "party", "file_name", "names")
    return documents.join(p, "doc_id", "left").join(i, "doc_id", "left").select("doc_id", F.coalesce("pages", rest).alias("text"))


def next_and_previous(documents: DataFrame, relationships: DataFrame, kinds: tuple[str, ...] = ("parent_child", "revision", "amendment")) -> DataFrame:
    """doc_id, previous_id, next_id: the best incoming relation's source (by confidence, then the latest) and the best outgoing one's target (by confidence, then the earliest)."""
    r = relationships.filter(F.col("relationship_type").isin(*kinds))
    day = documents.select(F.col("doc_id").alias("other"), F.unix_date("date_created").alias("day"))
    into = r.select(F.col("target_doc_id").alias("doc_id"), F.col("source_doc_id").alias("other"), "confidence").join(day, "other")
    out = r.select(F.col("source_doc_id").alias("doc_id"), F.col("target_doc_id").alias("other"), "confidence").join(day, "other")
    best = lambda df, d, name: df.groupBy("doc_id").agg(F.min_by("other", F.struct(-F.col("confidence"), d, "other")).alias(name))
    return documents.select("doc_id").join(best(into, -F.col("day"), "previous_id"), "doc_id", "left").join(best(out, F.col("day"), "next_id"), "doc_id", "left")


def match_details(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Registered matches with both items' documents, descriptions and amounts."""
    cols = ("doc_id", "description", "amount")
    one = items.select("item_id", *cols).dropDuplicates(["item_id"])
    end = lambda name: one.select(F.col("item_id").alias(f"{name}_item_id"), *(F.col(c).alias(f"{name}_{c}") for c in cols))
    return matches.join(end("source"), "source_item_id").join(end("target"), "target_item_id")


def financial_journey(items: DataFrame, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Of each group: first and last date, days between, documents, items, and types and parties in alphabetical order."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(c + "s")
    g = items.groupBy(*by).agg(F.min("date_created").alias("first"), F.max("date_created").alias("last"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("items"), names("doc_type"), names("party"))
    return g.withColumn("days", F.datediff("last", "first"))
