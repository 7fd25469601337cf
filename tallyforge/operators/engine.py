"""Detectors together: findings in one shape, per document and over all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.texts import confidence_level
from tallyforge.operators import aggregates, matching, network_rules, rules, sequences, splits, statements
from tallyforge.storage import stored


def finding(df: DataFrame, kind: str, subject: str, confidence: str = "confidence") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.col(confidence).cast("double").alias("confidence"))


def suspicious_patterns(documents: DataFrame, items: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """kind, subject, confidence, level of every detector's findings of enough confidence. Items are written once, as each detector reads them."""
    items = stored(items.select("project_id", "item_id", "doc_id", "doc_type", "party", "status", "item_status", "date_created", "description", "amount", "quantity", "unit_price", "cost_code"), "items")
    key = aggregates.coarse(F.col("amount"), 1)
    found = [
        finding(aggregates.recurring_amounts(items, key), "recurring_amount", "key"),
        finding(rules.reappearing_amounts(items), "reappearing_amount", "item_id"),
        finding(aggregates.markup_variance(items, ("cost_code",)).filter("inconsistent"), "inconsistent_markup", "cost_code"),
        finding(sequences.gaps(documents).filter("unusual"), "unusual_gap", "doc_id"),
        finding(sequences.amounts_before_approval(items, documents), "amount_before_approval", "item_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter(F.col("confidence") >= min_confidence).withColumn("level", confidence_level(F.col("confidence")))


def anomalies(items: DataFrame, documents: DataFrame) -> DataFrame:
    """kind, subject, confidence of statistical and rule anomalies. Items are written once, as each detector reads them."""
    items = stored(items.select("project_id", "item_id", "doc_id", "doc_type", "party", "date_created", "description", "amount", "cost_code"), "items")
    i = items.withColumn("value", F.col("amount").cast("double"))
    found = [
        finding(sequences.zscore_outliers(i, "value", ("cost_code", "doc_type", "party")), "amount_outlier", "item_id"),
        finding(rules.unusually_large(items), "unusually_large", "item_id"),
        finding(rules.suspicious_descriptions(items), "suspicious_description", "item_id"),
        finding(rules.round_amounts(items), "round_amount", "item_id", "score"),
        finding(rules.missing_change_orders(items, documents), "missing_change_order", "item_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def disputed_amounts(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Items that were rejected and came again, or are billed without a change order: item_id, why, confidence; the surer reason of each item."""
    a = rules.reappearing_amounts(items).select("item_id", F.lit("reappeared").alias("why"), "confidence")
    b = rules.missing_change_orders(items, documents).select("item_id", F.lit("missing change order").alias("why"), "confidence")
    return a.unionByName(b).groupBy("item_id").agg(F.max_by("why", F.struct("confidence", "why")).alias("why"), F.max("confidence").alias("confidence"))


def analyze_document(documents: DataFrame, items: DataFrame, relationships: DataFrame, doc_id) -> dict[str, DataFrame]:
    """What is known of one document, as lazy frames."""
    mine = items.filter(F.col("doc_id") == doc_id)
    return {
        "items": mine,
        "anomalies": anomalies(items, documents).join(mine.select(F.col("item_id").alias("subject")), "subject", "left_semi"),
        "relationships": relationships.filter((F.col("source_doc_id") == doc_id) | (F.col("target_doc_id") == doc_id)),
        "timeline": sequences.key_events(documents).filter(F.col("doc_id") == doc_id),
    }


def summary(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row: documents, items, total, rejected total and its share in percent."""
    d = documents.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("project_id").alias("projects"))
    i = items.agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("total"), F.sum(F.when(F.col("item_status") == "rejected", F.col("amount"))).alias("rejected"))
    # One row each.
    return d.crossJoin(i).withColumn("rejected_percent", F.col("rejected").cast("double") / F.col("total").cast("double") * 100)


def analyze_amount(items: DataFrame, documents: DataFrame, amount: float) -> dict[str, DataFrame]:
    """What is known of an amount, as lazy frames: matches (to 1 %, or to 10 % if there are none), history, anomalies, relations and doubts."""
    found = matching.exact_matches(items, amount)
    if not found.limit(1).count():
        found = matching.fuzzy_matches(items, amount).drop("confidence")
    ids = found.select("item_id").distinct()
    return {
        "matches": found,
        "history": matching.amount_chronology(items, amount),
        "anomalies": anomalies(items, documents).join(ids.withColumnRenamed("item_id", "subject"), "subject", "left_semi"),
        "relations": matching.linked_items(items).join(ids.withColumnRenamed("item_id", "a_item_id"), "a_item_id", "left_semi"),
        "disputed": disputed_amounts(items, documents).join(ids, "item_id", "left_semi"),
    }


def rule_anomalies(items: DataFrame, documents: DataFrame, applications: DataFrame | None = None, completion: DataFrame | None = None) -> DataFrame:
    """kind, subject, confidence of all nine rule detectors: running totals, systematic rounding, math errors, large amounts, suspicious descriptions, round amounts, month ends, mismatched totals, missing change orders.

    applications (project_id, doc_id, number, meta_data) and completion (project_id, doc_id, number, item_number, item_id, share) are what
    running totals are checked on, where they are given. Month ends take 0.7 and a tenth of what their ratio exceeds, mismatched totals
    0.8 and the difference's share of the total; at most 0.95.
    """
    found = []
    if applications is not None:
        found.append(splits.certificate_mismatches(applications).select("kind", F.col("doc_id").cast("string").alias("subject"), "confidence"))
    if completion is not None:
        found.append(finding(splits.completion_regressions(completion), "decreasing_completion_percentage", "item_id"))
    late = aggregates.end_of_month_anomalies(documents).withColumn("confidence", F.least(F.lit(0.95), 0.6 + 0.1 * (F.col("ratio") - 2.0) + 0.1 * F.least(F.lit(1.0), F.col("total").cast("double") / 10_000)))
    totals = aggregates.mismatched_totals(documents, items).withColumn("confidence", F.least(F.lit(0.95), 0.7 + F.least(F.lit(0.25), F.coalesce(F.try_divide(F.abs("difference") * 5.0, F.abs("item_cents").cast("double")), F.lit(0.25)))))
    errors = statements.statement_errors(items, documents if "meta_data" in documents.columns else documents.withColumn("meta_data", F.lit(None).cast("string")))
    found += [
        finding(aggregates.systematic_rounding(items).filter("confidence IS NOT NULL"), "systematic_rounding_pattern", "party"),
        errors.select(F.concat(F.lit("math_error_"), "check").alias("kind"), F.coalesce("item_id", F.col("doc_id").cast("string")).alias("subject"), "confidence"),
        finding(statements.systematic_errors(errors), "systematic_math_errors", "party"),
        finding(rules.unusually_large(items), "unusually_large", "item_id"),
        finding(rules.suspicious_descriptions(items), "suspicious_description", "item_id"),
        finding(rules.round_amounts(items), "round_amount", "item_id", "score"),
        finding(late, "end_of_month", "doc_id"),
        finding(totals, "mismatched_total", "doc_id"),
        finding(rules.missing_change_orders(items, documents), "missing_change_order", "item_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def statistical_anomalies(items: DataFrame) -> DataFrame:
    """kind, subject, confidence of the three statistical detectors: amounts by either method, distributions of documents, frequencies of amounts."""
    surer = lambda df: df.withColumn("confidence", F.least(F.lit(0.95), 0.7 + 0.05 * (F.abs("z") - 2.5)))
    found = [
        finding(network_rules.amount_outliers(items), "amount_outlier", "item_id"),
        finding(surer(aggregates.distribution_anomalies(items)), "distribution_anomaly", "doc_id"),
        finding(surer(aggregates.frequency_anomalies(items, F.col("amount"))), "frequency_anomaly", "key"),
    ]
    return reduce(DataFrame.unionByName, found)


def all_anomalies(items: DataFrame, documents: DataFrame, applications: DataFrame | None = None, completion: DataFrame | None = None, scores: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """kind, subject, confidence of statistical and rule anomalies, and, with scores (id, score) of an outlier model, of items that score `least` or more."""
    out = statistical_anomalies(items).unionByName(rule_anomalies(items, documents, applications, completion))
    if scores is None:
        return out
    return out.unionByName(finding(scores.filter(F.col("score") >= least), "model_outlier", "id", "score"))
