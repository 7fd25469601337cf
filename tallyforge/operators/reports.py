"""Report tables, evidence and texts. Writers give CSV, Parquet or Markdown; what they write is aggregated first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.amounts import format_currency
from tallyforge.operators import aggregates, engine
from tallyforge.operators.ordered import ranked


def sheets(documents: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The tables of a financial summary: totals, items, disputed items, documents, and counts by type and party."""
    return {
        "summary": engine.summary(documents, items),
        "line_items": items.select("doc_id", "item_id", "description", format_currency(F.col("amount")).alias("amount"), "category", "item_status"),
        "disputed": engine.disputed_amounts(items, documents),
        "documents": documents.select("doc_id", "doc_type", "party", "status", "date_created", format_currency(F.col("total")).alias("total")),
        "by_type": aggregates.counts(documents, "doc_type"),
        "by_party": aggregates.counts(documents, "party"),
    }


def write_sheets(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """A folder for each table, as csv (with a header), parquet or json."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{path}/{name}")


def evidence(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings (kind, subject, confidence) about items with the item's document, amount and a citation, numbered by confidence within their kind."""
    one = items.select(F.col("item_id").alias("subject"), "doc_id", "description", "amount").dropDuplicates(["subject"])
    cite = F.concat_ws(" ", F.col("description"), F.lit("for"), format_currency(F.col("amount")), F.lit("in document"), F.col("doc_id").cast("string"))
    found = ranked(findings.join(one, "subject"), ("kind",), F.desc("confidence"), "subject", out="_k")
    return found.withColumns({"evidence": F.concat(F.lit("evidence_"), (F.col("_k") + 1).cast("string")), "citation": cite}).drop("_k")


def amount_sentence(items: DataFrame, amount: float) -> DataFrame:
    """One row with a sentence on where an amount occurs."""
    found = items.filter(F.abs(F.col("amount") - F.lit(str(amount)).cast("decimal(15,2)")) <= 0.01)
    g = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d"), F.min("date_created").alias("first"), F.max("date_created").alias("last"), F.concat_ws(", ", F.array_sort(F.collect_set("doc_type"))).alias("types"))
    return g.select(F.format_string("The amount %s occurs %d times in %d documents (%s), from %s to %s.", F.lit(f"${amount:,.2f}"), "n", "d", "types", F.col("first").cast("string"), F.col("last").cast("string")).alias("text"))


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A report of the first `rows` rows of each table, in Markdown. Only those come to the driver."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name.replace('_', ' ').title()}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(out) + "\n"


def narrative(documents: DataFrame, items: DataFrame, disputed: DataFrame, patterns: DataFrame) -> DataFrame:
    """section, text: sentences on the whole, on disputed amounts (item_id, why), and on patterns (kind, confidence)."""
    n = engine.summary(documents, items)
    dollars = lambda c: format_currency(F.coalesce(c, F.lit(0)).cast("decimal(25,2)"))
    d = disputed.join(items.select("item_id", "amount").dropDuplicates(["item_id"]), "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    p = patterns.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("high"))
    # One row each.
    one = n.crossJoin(d.select(F.col("total").alias("disputed")))
    return (
        one.select(F.lit("summary").alias("section"), F.concat(F.lit("Of "), F.col("documents").cast("string"), F.lit(" documents with "), F.col("items").cast("string"), F.lit(" line items, "), dollars(F.col("disputed")), F.lit(" is in dispute.")).alias("text"))
        .unionByName(d.select(F.lit("disputed amounts").alias("section"), F.when(F.col("n") == 0, "No disputed amounts were found.").otherwise(F.concat(F.col("n").cast("string"), F.lit(" disputed amounts come to "), dollars(F.col("total")), F.lit("."))).alias("text")))
        .unionByName(p.select(F.concat(F.lit("pattern: "), F.col("kind")).alias("section"), F.concat(F.col("n").cast("string"), F.lit(" findings, confidence up to "), F.format_number("high", 2), F.lit(".")).alias("text")))
    )


def document_reports(documents: DataFrame, items: DataFrame, relationships: DataFrame) -> DataFrame:
    """doc_id, text: a sentence on every document: its type, party, date, items, total, and relations."""
    i = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("sum"))
    ends = relationships.select(F.explode(F.array("source_doc_id", "target_doc_id")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("relations"))
    d = documents.join(i, "doc_id", "left").join(ends, "doc_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat(F.coalesce("doc_type", F.lit("document")), F.lit(" of "), F.coalesce("party", F.lit("unknown")), F.lit(", "), F.coalesce(F.col("date_created").cast("string"), F.lit("undated")), F.lit(": "), number(F.col("n")), F.lit(" items, "), format_currency(F.coalesce("sum", F.lit(0)).cast("decimal(25,2)")), F.lit(", "), number(F.col("relations")), F.lit(" relations"))
    return d.select("doc_id", text.alias("text"))


def timeline_sentences(documents: DataFrame) -> DataFrame:
    """project_id, text: the span of each project's documents, how many there are, and how many of each type."""
    n = documents.filter("doc_type IS NOT NULL").groupBy("project_id", "doc_type").agg(F.count(F.lit(1)).alias("n"))
    types = n.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_type", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["doc_type"])), ", ").alias("types"))
    span = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("k"), F.min("date_created").alias("first"), F.max("date_created").alias("last"))
    text = F.concat(F.lit("From "), F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"), F.lit(" ("), F.datediff("last", "first").cast("string"), F.lit(" days), "), F.col("k").cast("string"), F.lit(" documents: "), F.coalesce("types", F.lit("of no known type")))
    return span.join(types, "project_id", "left").select("project_id", F.coalesce(text, F.concat(F.col("k").cast("string"), F.lit(" documents without a clear timeline"))).alias("text"))


def amount_tables(items: DataFrame, documents: DataFrame, amount: float) -> dict[str, DataFrame]:
    """The tables of one amount: summary, matches, anomalies."""
    from tallyforge.operators import matching

    found = matching.exact_matches(items, amount)
    odd = engine.anomalies(items, documents)
    return {"summary": amount_sentence(items, amount), "matches": found.select("item_id", "doc_id", "description", "amount", "date_created"), "anomalies": odd.join(found.select(F.col("item_id").alias("subject")), "subject", "left_semi")}


def financial_report(documents: DataFrame, items: DataFrame, relationships: DataFrame) -> dict[str, DataFrame]:
    """All tables of a report, for write_sheets(): those of sheets(), patterns, anomalies, relations, evidence and narrative."""
    patterns, odd, disputed = engine.suspicious_patterns(documents, items), engine.anomalies(items, documents), engine.disputed_amounts(items, documents)
    return sheets(documents, items) | {
        "patterns": patterns,
        "patterns_by_kind": patterns.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("high")),
        "anomalies": odd,
        "relationships": document_relations(documents, relationships),
        "evidence": evidence(odd, items),
        "narrative": narrative(documents, items, disputed, patterns),
    }


def document_relations(documents: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relations of which either end is among the documents."""
    ids = documents.select(F.col("doc_id").alias("id")).distinct()
    a = relationships.join(ids, F.col("source_doc_id") == F.col("id"), "left_semi")
    b = relationships.join(ids, F.col("source_doc_id") == F.col("id"), "left_anti").join(ids, F.col("target_doc_id") == F.col("id"), "left_semi")
    return a.unionByName(b)


def stored_evidence(report_id: int, found: DataFrame) -> DataFrame:
    """Rows of report_evidence from evidence(): one for each document, and one for each item."""
    base = {"report_id": F.lit(report_id).cast("long"), "citation_text": F.col("citation"), "relevance_score": F.col("confidence").cast("decimal(5,2)")}
    docs = found.groupBy("doc_id").agg(F.min_by("citation", F.struct(-F.col("confidence"), "citation")).alias("citation"), F.max("confidence").alias("confidence")).select(*(c.alias(n) for n, c in base.items()), F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("item_id"))
    return docs.unionByName(found.select(*(c.alias(n) for n, c in base.items()), F.col("doc_id").cast("string").alias("doc_id"), F.col("subject").alias("item_id")))
