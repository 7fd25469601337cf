"""Metadata, amounts, dates, tables and line items from document text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell a document's type, tried in this order; and header words of money tables (fixed values).
TYPE_WORDS = (("payment_app", ("application for payment", "payment application", "pay app", "certificate for payment")), ("change_order", ("change order", "change directive", "modification")), ("invoice", ("invoice", "bill to", "amount due")), ("contract", ("contract", "agreement")), ("correspondence", ("dear", "sincerely", "regarding", "subject:")))
MONEY_HEADERS = ("amount", "total", "price", "cost", "subtotal", "balance", "sum", "payment", "claim", "value", "$", "usd", "dollar")
MATERIALS = ("concrete", "steel", "framing", "electrical", "plumbing", "foundation", "structural", "insulation", "drywall", "roofing", "flooring", "ceiling", "window", "door", "hardware", "lighting", "paint", "finish", "site work")
_MONEY = r"\$\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})"


def document_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("other")
    for name, words in reversed(TYPE_WORDS):
        hit = F.lit(False)
        for w in words:
            hit |= low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def first_group(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def money(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def amounts(text: Column) -> Column:
    """All dollar amounts, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_MONEY), F.lit(1)), money)


def materials(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(m), F.lit(m)) for m in MATERIALS)))


def approval(text: Column) -> Column:
    """approved, rejected, pending or none by words; contradictory if both of the first two occur. 'not approved' and 'disapproved' are rejections."""
    low = F.lower(text)
    no = low.rlike(r"reject|denied|declin|disapprov|not approved")
    yes = F.regexp_replace(low, "disapprov|not approved", "").rlike("approv|accepted")
    return F.when(no & yes, "contradictory").when(no, "rejected").when(yes, "approved").when(low.rlike("pending|under review|submitted"), "pending").otherwise("none")


def metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with doc_type, number, document_date, total, amounts (count, low, high, mean), near_threshold (two or more from 4000 to 5000), approval, materials."""
    t, a = F.col(text), F.col("_a")
    total = first_group(t, r"(?i)total(?:\s+amount)?(?:\s+due)?\s*:?\s*" + _MONEY, r"(?i)amount\s+due\s*:?\s*" + _MONEY, r"(?i)contract\s+sum\s*:?\s*" + _MONEY)
    number = first_group(t, r"(?i)change order (?:no|number|#)[.:]?\s*([A-Za-z0-9-]+)", r"(?i)application no[.:]?\s*([A-Za-z0-9-]+)", r"(?i)invoice (?:no|number|#)[.:]?\s*([A-Za-z0-9-]+)")
    date = first_group(t, r"(?i)(?:date|dated)\s*:?\s*" + _DATE, _DATE)
    return docs.withColumn("_a", amounts(t)).withColumns({
        "doc_type": document_type(t), "number": number, "document_date": date, "total": money(total), "n_amounts": F.size(a), "low": F.array_min(a), "high": F.array_max(a),
        "mean": F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double")), "near_threshold": F.size(F.filter(a, lambda x: x.between(4000, 5000))) >= 2, "approval": approval(t), "materials": materials(t),
    }).drop("_a")


def financial_checks(docs: DataFrame, text: str = "text", tolerance: float = 0.1) -> DataFrame:
    """Payment figures stated in a text, and whether they agree: retainage = rate of completed; due = completed - retainage - previous; balance = contract + changes - completed. Null where figures are missing."""
    of = lambda p: money(first_group(F.col(text), r"(?i)" + p + r"[^$\n]*" + _MONEY))
    rate = first_group(F.col(text), r"(?i)retainage\s*\(([0-9.]+)%\)").try_cast("double")
    d = docs.withColumns({"contract": of("contract sum"), "changes": of("change orders to date"), "completed": of("completed to date"), "retainage": of("retainage"), "previous": of("previous certificates"), "due": of("current payment due"), "balance": of("balance to finish"), "rate": rate})
    near = lambda a, b: F.abs(a - b) <= tolerance
    c = F.col
    return d.withColumns({"retainage_ok": near(c("completed") * c("rate") / 100, c("retainage")), "due_ok": near(c("completed") - c("retainage") - c("previous"), c("due")), "balance_ok": near(c("contract") + F.coalesce("changes", F.lit(0.0)) - c("completed"), c("balance"))})


def table_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block, line, cells: lines of two or more cells (split at |, tabs or two blanks), numbered; neighbouring ones form a block of at least two."""
    from pyspark.sql.window import Window

    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
    cells = F.filter(F.transform(F.split("raw", r"\s*\|\s*|\t+| {2,}"), lambda x: F.trim(x)), lambda x: x != "")
    # Out of an array of one, so that the filter does not split a line again.
    rows = lines.select(key, "line", "raw", F.explode(F.array(cells)).alias("cells")).filter((F.size("cells") >= 2) & ~F.col("raw").rlike(r"^[\s|+=-]+$"))
    w = Window.partitionBy(key).orderBy("line")
    rows = rows.withColumn("block", F.col("line") - F.row_number().over(w))
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "block"))).filter("_n >= 2").select(key, "block", "line", "cells")


def line_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, description, amount from lines that end with an amount; lines that begin with total, subtotal or sum are none."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
    p = r"^\s*(?:\d+[.)]?\d*\s*[.:,|-]?\s+)?([A-Za-z][^$|\n]{2,}?)\s*[|:,-]?\s*\$\s?([0-9][0-9,]*(?:\.[0-9]{2})?)\s*$"
    got = lines.select(key, "line", F.trim(F.regexp_extract("raw", p, 1)).alias("description"), money(F.regexp_extract("raw", p, 2)).alias("amount"))
    return got.filter("amount IS NOT NULL").filter(~F.lower("description").rlike(r"^(grand )?(total|subtotal|sum)\b"))


def is_money_table(cells: Column) -> Column:
    """Whether a header's cells name money."""
    return F.exists(cells, lambda c: F.lower(c).rlike("|".join(w.replace("$", r"\$") for w in MONEY_HEADERS)))


#: Fields of each document type, by pattern (fixed values).
FIELDS = {
    "invoice": {"invoice_number": r"(?i)invoice\s*(?:no|number|#)\.?\s*:?\s*([A-Za-z0-9-]+)", "invoice_date": r"(?i)date\s*:?\s*" + _DATE, "invoice_total": r"(?i)total[^$\n]*" + _MONEY},
    "payment_app": {"application_number": r"(?i)application\s*no\.?\s*:?\s*([A-Za-z0-9-]+)", "period_start": r"(?i)period\s+from\s*:?\s*" + _DATE, "period_end": r"(?i)(?:period\s+)?to\s*:\s*" + _DATE, "contract_sum": r"(?i)contract\s+sum[^$\n]*" + _MONEY, "payment_due": r"(?i)payment\s+due[^$\n]*" + _MONEY},
    "change_order": {"change_order_number": r"(?i)change\s+order\s*(?:no|number|#)\.?\s*:?\s*([A-Za-z0-9-]+)", "change_order_date": r"(?i)date\s*:?\s*" + _DATE, "change_order_amount": r"(?i)total\s+change\s+order\s+amount[^$\n]*" + _MONEY},
    "correspondence": {"subject": r"(?im)^(?:subject|re)\s*:\s*(.+)$", "sender": r"(?im)^from\s*:\s*(.+)$", "recipient": r"(?im)^to\s*:\s*(.+)$", "letter_date": r"(?i)date\s*:?\s*" + _DATE},
    "contract": {"contract_date": r"(?i)(?:contract\s*)?date[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", "contract_sum": r"(?i)contract\s*(?:sum|amount)[:\s]*\$?([0-9,]+\.[0-9]{2})"},
    "schedule": {"schedule_date": r"(?i)date\s*:?\s*" + _DATE, "revision": r"(?i)rev(?:ision)?\.?\s*:?\s*([A-Za-z0-9]+)"},
}


def fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fields: a map of what its document type's patterns find, without those that find nothing."""
    kind, out = document_type(F.col(text)), F.create_map().cast("map<string,string>")
    for name, patterns in FIELDS.items():
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.trim(first_group(F.col(text), p)).alias("value")) for k, p in patterns.items()))
        out = F.when(kind == name, F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))).otherwise(out)
    return docs.withColumn("fields", out)


#: Patterns of project information, tried in order; and of references to other documents, with the words that tell their type (fixed values).
PROJECT = {"project_name": (r"PROJECT(?: NAME| TITLE)?:\s*([^\n]+)",), "project_number": (r"Project ID:\s*([\w-]+)", r"(?:PROJECT NUMBER|PROJECT ID|CONTRACT NUMBER):\s*([\w-]+)")}
PARTIES = ("contractor", "owner", "architect")
REFERENCES = (
    (r"(?i)(?:change order|co)[\s#:.]+\d+", "change_order"), (r"(?i)(?:payment application|pay app|application)[\s#:.]+\d+", "payment_app"), (r"(?i)(?:invoice|billing)[\s#:.]+[a-z0-9-]{2,}", "invoice"),
    (r"(?i)(?:contract|agreement)[\s#:.]+[a-z0-9-]{2,}", "contract"), (r"(?i)(?:letter|email|memo) dated[\s:]+[a-z]+ \d{1,2}, \d{4}", "correspondence"),
)


def project_information(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with project_name, project_number, contractor, owner, architect (each up to a blank line or the next party) and follows, the number of a change order that this one says it follows. Null where a text doesn't say."""
    t = F.col(text)
    stop = "|".join(p.upper() for p in PARTIES)
    party = {p: F.nullif(F.trim(F.regexp_extract(t, rf"(?s){p.upper()}:\s*(.+?)(?:\n\s*\n|\n(?:{stop})|\z)", 1)), F.lit("")) for p in PARTIES}
    follows = first_group(t, r"(?i)(?:follows|following|subsequent to|related to|continuation of)[^.]*?(?:change order|co)[\s#:.]+(\d+)", r"(?i)(?:change order|co)[\s#:.]+(\d+)[^.]*?(?:series|sequence|chain|related)")
    return docs.withColumns({name: F.trim(first_group(t, *patterns)) for name, patterns in PROJECT.items()} | party | {"follows": F.when(document_type(t) == "change_order", follows)})


def references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, reference, status of every mention of another document. status: approved or rejected if the words before it in its sentence say so, else null."""
    # The words before a mention are only sought in texts that have one, and a text is read once for all kinds.
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(F.col(text).rlike(p), F.regexp_extract_all(F.col(text), F.lit(r"(?i)([^.]{0,60}?" + p[4:] + ")"), F.lit(1))).alias("all")) for p, k in REFERENCES))
    found = docs.select(key, F.explode(every).alias("m")).filter("m.all IS NOT NULL").select(key, "m.kind", F.explode("m.all").alias("at"))
    whole = F.coalesce(*(F.when(F.col("kind") == k, F.regexp_extract("at", p, 0)) for p, k in REFERENCES))
    found = found.select(key, "kind", "at", whole.alias("whole"))
    low = F.lower("at")
    status = F.when(low.rlike("reject|denied"), "rejected").when(low.rlike("approv|accepted"), "approved")
    return found.select(key, "kind", F.regexp_extract("whole", r"([A-Za-z0-9-]+(?: \d{1,2}, \d{4})?)$", 1).alias("reference"), status.alias("status"))


#: Words of header cells, by role (fixed values).
HEADER_WORDS = ("total", "subtotal", "item", "description", "qty", "quantity", "amount", "price", "cost", "date", "no.", "number", "unit")
ROLES = {"description": ("description", "item", "work", "scope", "detail"), "amount": ("amount", "total", "cost", "price", "value", "sum"), "quantity": ("qty", "quantity", "count", "units"), "unit_price": ("unit price", "unit cost", "rate", "price per")}


def is_header(cells: Column) -> Column:
    """Whether over half of a row's cells are in capitals, or one has a header word."""
    capital = F.size(F.filter(cells, lambda c: c.rlike("[A-Z]") & (c == F.upper(c))))
    return (capital > F.floor(F.size(cells) / 2)) | F.exists(cells, lambda c: _has(F.lower(c), HEADER_WORDS))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= text.contains(w)
    return out


def key_columns(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each block of table_rows(): key, block, header (its cells, null without one), and the 0-based places of the columns description, amount, quantity, unit_price.

    By header words; a description is otherwise the first column of which over half the cells are texts of over five characters, an
    amount the column with most cells that look like money, if any does.
    """
    first = tables.groupBy(key, "block").agg(F.min(F.struct("line", "cells")).alias("f")).select(key, "block", F.col("f.line").alias("first"), F.when(is_header(F.col("f.cells")), F.col("f.cells")).alias("header"))
    body = tables.join(first, [key, "block"]).filter(F.col("header").isNull() | (F.col("line") > F.col("first")))
    cell = body.select(key, "block", F.posexplode("cells").alias("at", "cell"))
    texts = (F.length("cell") > 5) & ~F.col("cell").rlike(r"^[-+$\d.,()\s%]+$")
    money_like = F.col("cell").rlike(r"\$\s*[\d,.]+|\d{1,3}(?:,\d{3})*\.\d{2}")
    per = cell.groupBy(key, "block", "at").agg(F.avg(texts.cast("double")).alias("texts"), F.sum(money_like.cast("int")).alias("money"))
    guess = per.groupBy(key, "block").agg(F.min(F.when(F.col("texts") > 0.5, F.col("at"))).alias("text_at"), F.min(F.struct((-F.col("money")).alias("m"), "at")).alias("m"))
    named = lambda words: F.nullif(F.array_position(F.transform("header", lambda c: _has(F.lower(c), words)), True) - 1, F.lit(-1))
    j = first.join(guess, [key, "block"], "left")
    fallback = {"description": F.col("text_at"), "amount": F.when(F.col("m.m") < 0, F.col("m.at"))}
    return j.select(key, "block", "header", *(F.coalesce(named(words), fallback.get(role, F.lit(None))).cast("int").alias(role) for role, words in ROLES.items()))


def table_items(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block, line, description, amount, quantity, unit_price from rows of table_rows(); rows named as totals, and rows with neither description nor amount, are none. tables are written once."""
    from tallyforge.functions.amounts import normalize_amount
    from tallyforge.storage import stored

    # Lines are read three times below, and splitting them is most of the work.
    tables = stored(tables, "tables")
    j = tables.join(key_columns(tables, key), [key, "block"]).filter(F.col("header").isNull() | (F.col("cells") != F.col("header")))
    at = lambda role: F.get("cells", F.col(role))
    figures = F.struct(at("description").alias("description"), *(normalize_amount(at(c)).alias(c) for c in ("amount", "quantity", "unit_price")))
    rows = j.select(key, "block", "line", F.explode(F.array(figures)).alias("f")).select(key, "block", "line", "f.*")
    return rows.filter(~F.coalesce(F.lower("description").rlike("total|sum"), F.lit(False)) & (F.col("amount").isNotNull() | (F.coalesce("description", F.lit("")) != "")))


def embed(text: Column, dimensions: int = 1536) -> Column:
    """A stand-in for an embedding service: a unit vector that depends on the text alone, from the digests of the text and each place's number."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(F.coalesce(text, F.lit("")), F.lit("#"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0 - 0.5)
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.try_divide(x, length))


#: Kinds of dates, with what stands before them (fixed values).
DATE_KINDS = {
    "effective_date": r"(?:Effective Date|EFFECTIVE DATE)[:\s]+", "submission_date": r"(?:(?:Submission Date|SUBMISSION DATE|Submitted|SUBMITTED)[:\s]+|PERIOD (?:FROM|TO):?\s*)",
    "creation_date": r"(?:CONTRACT DATE|Date Created|Created on):?\s*", "response_date": r"(?:Response Date|RESPONSE DATE|Responded|RESPONDED)[:\s]+",
}
SUBSTITUTED, EXTRA = ("substitut", "replac", "instead of", "in lieu of", "alternate"), ("additional", "extra", "added", "supplemental", "new scope", "outside contract", "not in contract", "unforeseen", "field change", "modification", "amendment")
_ANY_DATE = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4})"


def dates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with document_date and the other kinds of dates as text; document_date falls back to the date of creation, of effect, of submission."""
    t = F.col(text)
    kinds = {k: first_group(t, p + _ANY_DATE) for k, p in DATE_KINDS.items()}
    own = first_group(t, r"(?:^|[^A-Za-z ] ?|\n)(?:Date|DATE|Dated|DATED)[:\s]+" + _ANY_DATE)
    return docs.withColumns(kinds | {"document_date": F.coalesce(own, kinds["creation_date"], kinds["effective_date"], kinds["submission_date"])})


def scope(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with scope (the passage so headed), substitutions and extra_work (sentences with such words), and whether one of the latter names a change order."""
    t = F.col(text)
    sentences = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"([^.!?]+[.!?])"), F.lit(1))
    some = lambda words: F.transform(F.filter(sentences, lambda s: _has(F.lower(s), words)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    head = F.nullif(F.trim(F.regexp_extract(t, r"(?is)(?:scope of work|description of work|scope)\s*:?\s*(.+?)(?:\n\s*\n|\z)", 1)), F.lit(""))
    d = docs.withColumns({"scope": head, "substitutions": some(SUBSTITUTED), "extra_work": some(EXTRA)})
    return d.withColumn("extra_work_has_order", F.exists("extra_work", lambda s: F.lower(s).rlike(r"change order|\bco\b")))
