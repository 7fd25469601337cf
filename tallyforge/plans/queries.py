"""Queries over one folder of tables, each an operator with its parameters, and the same question in SQL for an independent check.

Amounts in results are whole cents, so sums are exact in both engines; doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import amounts
from tallyforge.functions.amounts import ROUNDNESS, cents
from tallyforge.operators import aggregates as agg
from tallyforge.operators import detectors, disguised, engine, graph, lookups, matching, network_rules, outliers, relationships, reports, rules, search, sequences, splits, statements, structure, upserts
from tallyforge.plans.model import SQL, Model
from tallyforge.sources import extract

_QUERIES: dict[str, tuple[Callable[[Model], DataFrame], str | None]] = {}


def query(sql: str | None, model: bool = True):
    """Register a function of a Model. sql: what follows the model's common table expressions (with model), or a whole statement; None if SQL has no form of it."""

    def wrap(f: Callable[[Model], DataFrame]):
        _QUERIES[f.__name__] = f, (None if sql is None else f"WITH {SQL.strip()}\n{sql.strip()}" if model else sql.strip())
        return f

    return wrap


def _r(c: Column, name: str | None = None, places: int = 6) -> Column:
    return F.round(c.cast("double"), places).alias(name) if name else F.round(c.cast("double"), places)


def _c(name: str, alias: str | None = None) -> Column:
    return (F.col(name) * 100).cast("long").alias(alias or f"{name}_cents")


def _l(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _d(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


# --- lookups ---------------------------------------------------------------------------------------------------------------


@query("SELECT doc_type, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY doc_type")
def documents_by_type(m):
    return agg.counts(m.documents, "doc_type")


@query("SELECT party, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY party")
def documents_by_party(m):
    return agg.counts(m.documents, "party")


@query("SELECT doc_id, party, status, CAST(date_created AS VARCHAR) AS date_created FROM docs WHERE doc_type = 'change_order' AND status = 'rejected' AND date_created BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def documents_search(m):
    return lookups.search_documents(m.documents, doc_type="change_order", status="rejected", date_start="1996-01-01", date_end="1998-12-31").select("doc_id", "party", "status", _d("date_created"))


@query("SELECT party, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS total_cents FROM docs WHERE doc_type = 'change_order' AND status = 'approved' GROUP BY party")
def change_orders_by_status(m):
    d = lookups.search_documents(m.documents, doc_type="change_order", status="approved")
    return d.groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).select("party", "n", _c("total"))


@query("SELECT item_id, doc_id, description, c AS amount_cents FROM items WHERE lower(description) LIKE '%ring%' AND c BETWEEN 5000000 AND 5500000 AND doc_type = 'invoice'")
def line_item_search(m):
    return lookups.search_line_items(m.items, keyword="RING", min_amount=50_000, max_amount=55_000, doc_type="invoice").select("item_id", "doc_id", "description", _c("amount"))


@query("""
, pa AS (SELECT project_id, doc_id, number, lag(date_created) OVER w AS period_start, date_created AS period_end FROM docs WHERE doc_type = 'payment_app' WINDOW w AS (PARTITION BY project_id ORDER BY number))
SELECT doc_id, project_id, number, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end FROM pa
WHERE period_start BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' OR period_end BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""")
def payment_apps_by_period(m):
    return lookups.payment_applications_by_period(m.payment_applications, "1997-01-01", "1997-06-30").select("doc_id", "project_id", "number", _d("period_start"), _d("period_end"))


@query("SELECT docs.doc_id, CAST(count(lines.doc_id) AS BIGINT) AS item_count, CAST(coalesce(sum(lines.c), 0) AS BIGINT) AS item_total_cents FROM docs LEFT JOIN lines ON docs.doc_id = lines.doc_id GROUP BY docs.doc_id")
def document_totals_left_join(m):
    return lookups.document_totals(m.documents, m.line_items).select("doc_id", "item_count", _c("item_total"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS items, CAST(count(DISTINCT item_id) AS BIGINT) AS distinct_items, CAST(sum(c) AS BIGINT) AS total_cents, min(c) AS low_cents, max(c) AS high_cents, round(CAST(sum(c) AS DOUBLE) / count(*) / 100, 6) AS mean FROM lines GROUP BY doc_id")
def document_metadata(m):
    return lookups.document_metadata(m.line_items).select("doc_id", "items", "distinct_items", _c("total"), _c("low"), _c("high"), _r(F.col("mean"), "mean"))


@query("""
SELECT doc_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(DISTINCT project_id) AS BIGINT) AS projects, CAST(min(date_created) AS VARCHAR) AS first, CAST(max(date_created) AS VARCHAR) AS last,
  CAST(date_diff('day', min(date_created), max(date_created)) AS BIGINT) AS days FROM items WHERE abs(c - 5000000) * 1000 <= 10 * 5000000 GROUP BY doc_type""")
def amount_references_distribution(m):
    return lookups.amount_references(m.items, 50_000.0).select("doc_type", "n", "documents", "projects", _d("first"), _d("last"), _l("days"))


@query("""
, t AS (SELECT doc_id, count(*) AS k, sum(c) AS s FROM lines GROUP BY doc_id)
SELECT doc_type, party, CAST(count(*) AS BIGINT) AS documents, CAST(sum(coalesce(k, 0)) AS BIGINT) AS items, CAST(sum(coalesce(s, 0)) AS BIGINT) AS total_cents FROM docs LEFT JOIN t ON docs.doc_id = t.doc_id
WHERE date_created BETWEEN DATE '1997-03-01' AND DATE '1997-09-30' GROUP BY doc_type, party""")
def date_range_activity(m):
    return lookups.date_range_activity(m.documents, m.line_items, "1997-03-01", "1997-09-30").select("doc_type", "party", "documents", "items", _c("total"))


@query("SELECT item_id, CAST(date_created AS VARCHAR) AS date_created, c AS amount_cents FROM items WHERE c >= 9000000 ORDER BY items.date_created DESC, c DESC, item_id LIMIT 50")
def transactions_latest(m):
    return lookups.transactions(m.items, min_amount=90_000).select("item_id", _d("date_created"), _c("amount"))


@query("SELECT item_status, CAST(year(date_created) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS total_cents, min(c) AS low_cents, max(c) AS high_cents FROM items GROUP BY ALL")
def transactions_summary(m):
    return lookups.transactions_summary(m.items).select("item_status", _l("year"), "n", _c("total"), _c("low"), _c("high"))


@query("""
, d AS (SELECT project_id, date_created, count(*) AS items, sum(c) AS s FROM items GROUP BY ALL)
SELECT project_id, CAST(date_created AS VARCHAR) AS date_created, CAST(items AS BIGINT) AS items, CAST(s AS BIGINT) AS total_cents, CAST(sum(s) OVER (PARTITION BY project_id ORDER BY d.date_created) AS BIGINT) AS running_cents FROM d""")
def financial_timeline(m):
    return lookups.financial_timeline(m.items).select("project_id", _d("date_created"), "items", _c("total"), _c("running"))


@query("SELECT item_id, c - 5000000 AS difference_cents, round((c - 5000000) * 100.0 / 5000000, 6)::DOUBLE AS percent FROM lines WHERE abs(c - 5000000) * 1000 <= 1 * 5000000")
def similar_amounts(m):
    return lookups.find_similar_amounts(m.line_items, 50_000.0).select("item_id", F.round(F.col("difference") * 100).cast("long").alias("difference_cents"), _r(F.col("percent"), "percent"))


@query("""
SELECT doc_id, substring(text, CAST(greatest(1, p - 100) AS BIGINT), CAST(p - greatest(1, p - 100) + 4 + 100 AS BIGINT)) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'with') AS p FROM documents) WHERE p > 0""", model=False)
def content_search(m):
    return lookups.search_content(m.table("documents"), "With").select("doc_id", "snippet")


@query("""
, a AS (SELECT * FROM lines WHERE doc_id = 14), b AS (SELECT * FROM lines WHERE doc_id = 19)
SELECT a.item_id AS a_item_id, b.item_id AS b_item_id, CASE WHEN lower(a.description) = lower(b.description) THEN 'same description' WHEN contains(lower(a.description), lower(b.description)) OR contains(lower(b.description), lower(a.description)) THEN 'contained description' ELSE 'similar amount' END AS kind
FROM a, b WHERE contains(lower(a.description), lower(b.description)) OR contains(lower(b.description), lower(a.description)) OR abs(a.c - b.c) * 100 <= greatest(a.c, b.c)""")
def compare_documents(m):
    return lookups.compare_documents(m.line_items, 14, 19).select("a_item_id", "b_item_id", "kind")


# --- matching --------------------------------------------------------------------------------------------------------------


@query("SELECT item_id, c AS amount_cents, CAST(date_created AS VARCHAR) AS date_created FROM items WHERE abs(c - 4200000) * 1000 <= 10 * 4200000")
def exact_matches(m):
    return matching.exact_matches(m.items, 42_000.0).select("item_id", _c("amount"), _d("date_created"))


@query("SELECT item_id, c AS amount_cents FROM items WHERE abs(c - 4200000) <= 5000 AND date_created BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def matches_in_date_range(m):
    return matching.matches_in_date_range(m.items, 42_000.0, "1996-01-01", "1999-12-31", 5000).select("item_id", _c("amount"))


@query("""
SELECT a.project_id, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(abs(a.c - b.c)) AS BIGINT) AS off_cents FROM items a JOIN items b ON a.project_id = b.project_id AND a.doc_id <> b.doc_id AND abs(a.c - b.c) * 1000 <= 10 * a.c WHERE a.c > 0 AND b.c > 0 GROUP BY a.project_id""")
def item_matches_by_project(m):
    p = matching.item_matches(m.items)
    return p.groupBy("project_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.abs(F.col("a_c") - F.col("b_c"))).alias("off_cents"))


@query("""
SELECT a.item_id, CAST(count(*) AS BIGINT) AS matches, min(abs(a.c - b.c)) AS least_cents FROM lines a JOIN lines b ON abs(a.c - b.c) * 1000 <= 200 * a.c WHERE a.doc_id = 11 AND b.doc_id = 14 GROUP BY a.item_id""")
def matches_between_documents(m):
    p = matching.matches_between_documents(m.items, 11, 14, 200)
    return p.select("item_id", F.size("matches").cast("long").alias("matches"), F.col("matches")[0]["off"].alias("least_cents"))


@query("SELECT item_id, round(1 - abs(c - 10412300) * 1000.0::DOUBLE / (100 * 10412300), 6) AS confidence FROM lines WHERE abs(c - 10412300) * 1000 <= 100 * 10412300")
def fuzzy_matches(m):
    return matching.fuzzy_matches(m.line_items, 104_123.0).select("item_id", _r(F.col("confidence"), "confidence"))


def _rates_sql(rates, up, down):
    values = ", ".join(f"({r!r}::DOUBLE)" for r in rates)
    return f"""
, rates(rate) AS (VALUES {values}), adj AS (SELECT rate, '{up}' AS direction, 8000.0::DOUBLE * (1 + rate) AS adjusted FROM rates UNION ALL SELECT rate, '{down}', 8000.0::DOUBLE / (1 + rate) FROM rates)
SELECT direction, round(rate, 6) AS rate, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS amount_cents FROM lines, adj WHERE abs(c / 100.0::DOUBLE - adjusted) / adjusted <= 0.01::DOUBLE GROUP BY ALL"""


@query(_rates_sql(matching.MARKUP_RATES, "markup", "base"))
def markup_matches(m):
    return matching.markup_matches(m.line_items, 8000.0).groupBy("direction", "rate").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select("direction", _r(F.col("rate"), "rate"), "n", _c("amount"))


@query(_rates_sql(matching.TAX_RATES, "with_tax", "pre_tax"))
def tax_matches(m):
    return matching.tax_matches(m.line_items, 8000.0).groupBy("direction", "rate").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select("direction", _r(F.col("rate"), "rate"), "n", _c("amount"))


@query("""
, levels(level, rounded) AS (VALUES (1, 41234.0::DOUBLE), (10, 41230.0::DOUBLE), (100, 41200.0::DOUBLE), (1000, 41000.0::DOUBLE))
SELECT CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n FROM lines, levels WHERE abs(c / 100.0::DOUBLE - rounded) * 1000 <= rounded GROUP BY level""")
def rounded_matches(m):
    return matching.rounded_matches(m.line_items, 41_234.4).groupBy("level").agg(F.count(F.lit(1)).alias("n")).select(_l("level"), "n")


@query("""
, t(parts, target, confidence) AS (VALUES (2, 4800000.0 / 2, 0.9::DOUBLE), (3, 4800000.0 / 3, 0.85::DOUBLE), (4, 4800000.0 / 4, 0.8::DOUBLE)),
n AS (SELECT parts, confidence, item_id, c, row_number() OVER (PARTITION BY parts ORDER BY abs(c - target), item_id) AS k FROM lines, t WHERE abs(c - target) * 20 <= target)
SELECT CAST(parts AS BIGINT) AS parts, CAST(k AS BIGINT) AS k, item_id, c AS amount_cents, round(confidence, 6) AS confidence FROM n WHERE k <= parts QUALIFY count(*) OVER (PARTITION BY parts) = parts""")
def split_matches(m):
    return matching.split_matches(m.line_items, 48_000.0).select(_l("parts"), _l("k"), "item_id", _c("amount"), _r(F.col("confidence"), "confidence"))


@query("""
, p AS (SELECT item_id AS partner_id, c + 3000000 AS s FROM lines WHERE abs(c - 3000000) * 5 <= 3000000 AND c <> 3000000 ORDER BY abs(c - 3000000), item_id LIMIT 1)
SELECT partner_id, item_id, c AS amount_cents FROM lines, p WHERE abs(c - s) * 100 <= s""")
def combination_matches(m):
    return matching.combination_matches(m.line_items, 30_000.0).select("partner_id", "item_id", _c("amount"))


@query("""
, s AS (SELECT item_id, 0.4 * greatest(0, 1 - abs(c / 100.0::DOUBLE - 50000) / greatest(c / 100.0::DOUBLE, 50000) / 0.05) + 0.3 * CASE WHEN description = 'small ring' THEN 1.0 ELSE CAST(len(list_intersect(string_split(description, ' '), ['small', 'ring'])) AS DOUBLE) / len(list_distinct(list_concat(string_split(description, ' '), ['small', 'ring']))) END + 0.05 AS similarity
  FROM lines WHERE abs(c - 5000000) * 1000 <= 50 * 5000000)
SELECT item_id, round(similarity::DOUBLE, 6) AS similarity FROM s WHERE similarity >= 0.5""")
def context_matches(m):
    return matching.context_matches(m.line_items, 50_000.0, "small ring", 0.5).select("item_id", _r(F.col("similarity"), "similarity"))


_MARKUP_CASE = " ".join(f"WHEN abs(b.c * 10000 - a.c * {10000 + round(r * 10000)}) * 100 <= a.c * {10000 + round(r * 10000)} THEN 'markup {r:g}'" for r in matching.ITEM_MARKUPS)


@query(f"""
, r AS (SELECT a.doc_id, CASE WHEN abs(b.c - 2 * a.c) * 100 <= b.c THEN 'component' {_MARKUP_CASE} END AS kind FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.c < b.c WHERE a.c > 0)
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM r WHERE kind IS NOT NULL GROUP BY kind""")
def item_relations(m):
    return matching.item_relations(m.line_items).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("""
, p AS (SELECT a.doc_type AS a_type, b.doc_type AS b_type, date_diff('day', a.date_created, b.date_created) AS days, abs(a.c - b.c) * 100.0::DOUBLE / greatest(a.c, b.c) AS off
  FROM items a JOIN items b ON a.project_id = b.project_id AND a.doc_id <> b.doc_id AND abs(a.c - b.c) * 1000 <= 10 * a.c WHERE a.c > 0 AND b.c > 0 AND date_diff('day', a.date_created, b.date_created) BETWEEN 1 AND 365),
q AS (SELECT a_type, b_type, least(0.95, CASE WHEN off <= 1 THEN 0.9 WHEN off <= 5 THEN 0.8 ELSE 0.7 END + CASE WHEN days <= 7 THEN 0.1 WHEN days <= 30 THEN 0.05 WHEN days <= 90 THEN 0.0 ELSE -0.1 END
  + CASE WHEN (a_type = 'change_order' AND b_type = 'payment_app') OR (a_type = 'invoice' AND b_type = 'payment_app') THEN 0.1 WHEN a_type = b_type THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM p)
SELECT a_type, b_type, round(confidence, 2) AS confidence, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY ALL""")
def linked_items(m):
    return matching.linked_items(m.items).select("a_type", "b_type", _r(F.col("confidence"), "confidence", 2)).groupBy("a_type", "b_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT project_id, a_doc_id, b_doc_id, n, round(least(0.95, 0.7 + least(n / 10.0, 0.25))::DOUBLE, 6) AS confidence FROM (
  SELECT a.project_id, a.doc_id AS a_doc_id, b.doc_id AS b_doc_id, CAST(count(*) AS BIGINT) AS n FROM items a JOIN items b ON a.project_id = b.project_id AND a.doc_id < b.doc_id AND abs(a.c - b.c) * 1000 <= 10 * a.c WHERE a.c > 0 AND b.c > 0 GROUP BY ALL) WHERE n >= 2""")
def shared_item_documents(m):
    return matching.shared_item_documents(m.items).select("project_id", "a_doc_id", "b_doc_id", "n", _r(F.col("confidence"), "confidence"))


@query("SELECT doc_type, strftime(date_created, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS total_cents FROM items WHERE abs(c - 5000000) * 1000 <= 10 * 5000000 GROUP BY ALL")
def amount_history(m):
    return matching.amount_history(m.items, 50_000.0).select("doc_type", "month", "n", _c("total"))


# --- aggregates ------------------------------------------------------------------------------------------------------------


@query("""
SELECT c // 10000 * 100 AS amount, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(DISTINCT doc_type) AS BIGINT) AS types,
  round(least(0.95, 0.85 + count(*) / 10.0::DOUBLE * 0.05::DOUBLE + count(DISTINCT doc_id) / 3.0::DOUBLE * 0.1::DOUBLE)::DOUBLE, 6) AS confidence FROM items GROUP BY c // 10000 HAVING count(*) > 1""")
def matching_amounts(m):
    return agg.matching_amounts(m.items, agg.coarse(F.col("amount"))).select(F.col("key").alias("amount"), "n", "documents", "types", _r(F.col("confidence"), "confidence"))


@query("""
SELECT c AS amount_cents, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM items GROUP BY c HAVING count(*) > 1""")
def matching_amounts_exact(m):
    return agg.matching_amounts(m.items, cents(F.col("amount"))).select(F.col("key").alias("amount_cents"), "n", "documents")


@query("""
, w AS (SELECT DISTINCT c // 10000 AS k, string_split(description, ' ') AS d FROM items WHERE c > 0),
j AS (SELECT a.k, min(CAST(len(list_intersect(a.d, b.d)) AS DOUBLE) / len(list_distinct(list_concat(a.d, b.d)))) AS low FROM w a JOIN w b ON a.k = b.k GROUP BY a.k),
g AS (SELECT c // 10000 AS k, count(*) AS n, count(DISTINCT doc_type) AS types, count(DISTINCT party) AS parties FROM items WHERE c > 0 GROUP BY 1 HAVING count(*) > 2),
h AS (SELECT g.k, n, types, parties, low >= 0.6 AS alike FROM g JOIN j ON g.k = j.k),
f AS (SELECT *, least(0.95, 0.7 + 0.1 * least(1.0, n / 5.0::DOUBLE) + 0.1 * least(1.0, types / 3.0::DOUBLE) + CASE WHEN alike THEN 0 ELSE 0.15 END + CASE WHEN parties > 1 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence FROM h WHERE types > 1 OR parties > 1 OR NOT alike)
SELECT k * 100 AS amount, CAST(n AS BIGINT) AS n, CAST(types AS BIGINT) AS types, CAST(parties AS BIGINT) AS parties, alike, round(confidence, 6) AS confidence FROM f WHERE confidence >= 0.7""")
def recurring_amounts(m):
    return agg.recurring_amounts(m.items, agg.coarse(F.col("amount"))).select(F.col("key").alias("amount"), _l("n"), "types", "parties", "alike", _r(F.col("confidence"), "confidence"))


@query("""
, n AS (SELECT c // 10000 AS k, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1 HAVING count(*) > 1), s AS (SELECT count(*) AS k, avg(n) AS mean, stddev_pop(n) AS std FROM n)
SELECT n.k * 100 AS amount, n, round((n - mean) / std, 4) AS z FROM n, s WHERE s.k >= 5 AND std > 0 AND abs((n - mean) / std) > 2""")
def frequency_anomalies(m):
    return agg.frequency_anomalies(m.line_items, agg.coarse(F.col("amount")), z=2.0).select(F.col("key").alias("amount"), "n", _r(F.col("z"), "z", 4))


@query("""
, d AS (SELECT doc_id, doc_type, party, count(*) AS n, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS mean_amount FROM items GROUP BY ALL HAVING count(*) >= 3),
z AS (SELECT *, count(*) OVER w AS k, avg(mean_amount) OVER w AS g, stddev_pop(mean_amount) OVER w AS s FROM d WINDOW w AS (PARTITION BY doc_type, party))
SELECT doc_id, doc_type, party, CAST(n AS BIGINT) AS n, round(mean_amount, 4) AS mean_amount, round((mean_amount - g) / s, 4) AS z FROM z WHERE k >= 5 AND s > 0 AND abs((mean_amount - g) / s) > 2""")
def distribution_anomalies(m):
    return agg.distribution_anomalies(m.items, z=2.0, least_items=3).select("doc_id", "doc_type", "party", "n", _r(F.col("mean_amount"), "mean_amount", 4), _r(F.col("z"), "z", 4))


@query("SELECT cost_code, round(CAST(sum(c) AS DOUBLE) / count(*) / 100, 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM lines WHERE c > 0 GROUP BY cost_code")
def category_averages(m):
    return agg.category_averages(m.line_items).select("cost_code", _r(F.col("mean"), "mean"), "n")


@query("SELECT docs.doc_id, CAST(docs.c - sum(lines.c) AS BIGINT) AS difference_cents, CAST(count(*) AS BIGINT) AS n FROM docs JOIN lines ON docs.doc_id = lines.doc_id GROUP BY docs.doc_id, docs.c HAVING abs(docs.c - sum(lines.c)) * 1000 > 10 * abs(docs.c)")
def mismatched_totals(m):
    return agg.mismatched_totals(m.documents, m.line_items).select("doc_id", F.col("difference").alias("difference_cents"), "n")


_ROUND_CASE = " ".join(f"WHEN c >= {s * 100} AND c % {s * 100} = 0 THEN {v!r}" for s, v in ROUNDNESS)
_ROUNDNESS_SQL = f"""
b AS (SELECT *, CASE {_ROUND_CASE} WHEN regexp_matches(CAST(c // 100 AS VARCHAR), '0000|1111|2222|3333|4444|5555|6666|7777|8888|9999') THEN 0.7 WHEN regexp_matches(CAST(c // 100 AS VARCHAR), '999$') OR (c % 100 >= 95 AND c > 1000) THEN 0.6 ELSE 0 END::DOUBLE AS base FROM items),
rr AS (SELECT *, CASE WHEN base = 0 THEN 0 ELSE least(0.95, (base + least(0.1, c / 100.0::DOUBLE / 1000000 * 0.1)) * CASE WHEN c % 100 <> 0 THEN 0.8 ELSE 1 END)::DOUBLE END AS r FROM b)"""


@query(f""", {_ROUNDNESS_SQL.strip()}
SELECT party, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN r >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS round, round(avg(r), 6) AS mean_roundness, round(sum(CASE WHEN r >= 0.5 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS share FROM rr GROUP BY party""")
def systematic_rounding(m):
    return agg.systematic_rounding(m.items).select("party", "n", "round", _r(F.col("mean_roundness"), "mean_roundness"), _r(F.col("share"), "share"))


@query(f""", {_ROUNDNESS_SQL.strip()}
SELECT item_id, c AS amount_cents, round(r, 6) AS score FROM rr WHERE c >= 100000 AND r >= 0.55""")
def round_amounts(m):
    return rules.round_amounts(m.items, threshold=0.55).select("item_id", _c("amount"), _r(F.col("score"), "score"))


@query("""
, d AS (SELECT DISTINCT cost_code, description FROM lines), k AS (SELECT cost_code, count(*) AS k FROM d GROUP BY 1), w AS (SELECT cost_code, unnest(list_distinct(string_split(lower(description), ' '))) AS word FROM d)
SELECT w.cost_code, word, CAST(count(*) AS BIGINT) AS n FROM w JOIN k ON w.cost_code = k.cost_code WHERE length(word) > 3 GROUP BY w.cost_code, word, k.k HAVING count(*) >= greatest(2, k.k // 8)""")
def common_terms(m):
    return agg.common_terms(m.line_items, 8).select("cost_code", "word", "n")


@query("""
, g AS (SELECT party, strftime(date_created, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN day(date_created) > day(last_day(date_created)) - 3 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM docs GROUP BY ALL HAVING count(*) >= 5)
SELECT party, month, n, late, late * 30 > 1.5 * n * 3 AND late >= 3 AS clustered FROM g""")
def end_of_month_clustering(m):
    return agg.end_of_month_clustering(m.documents, factor=1.5).select("party", "month", "n", "late", "clustered")


@query("""
, d AS (SELECT *, strftime(date_created, '%Y-%m') AS month, day(date_created) > day(last_day(date_created)) - 3 AS late, day(last_day(date_created)) AS dim FROM docs),
e AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN late THEN 1 ELSE 0 END) OVER w AS k, sum(c) OVER w AS s, sum(CASE WHEN late THEN c ELSE 0 END) OVER w AS m FROM d WINDOW w AS (PARTITION BY party, month)),
f AS (SELECT *, greatest(k::DOUBLE / n, m::DOUBLE / s) / (3.0::DOUBLE / dim) AS ratio FROM e)
SELECT doc_id, party, month, round(ratio, 6) AS ratio FROM f WHERE n >= 3 AND late AND ratio > 1.8""")
def end_of_month_anomalies(m):
    return agg.end_of_month_anomalies(m.documents, factor=1.8).select("doc_id", "party", "month", _r(F.col("ratio"), "ratio"))


@query("SELECT doc_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN isodow(date_created) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS weekend, sum(CASE WHEN isodow(date_created) >= 6 THEN 1 ELSE 0 END) * 7 > count(*) * 3 AND sum(CASE WHEN isodow(date_created) >= 6 THEN 1 ELSE 0 END) >= 3 AS unusual FROM docs GROUP BY doc_type")
def weekend_timing(m):
    return agg.weekend_timing(m.documents)


_HOLIDAYS_SQL = """
, y AS (SELECT unnest(range(1994, 2003)) AS y),
h AS (SELECT make_date(y, 1, 1) AS d, 'New Year' AS name FROM y UNION ALL SELECT make_date(y, 7, 4), 'Independence Day' FROM y UNION ALL SELECT make_date(y, 12, 24), 'Christmas Eve' FROM y UNION ALL SELECT make_date(y, 12, 25), 'Christmas' FROM y UNION ALL SELECT make_date(y, 12, 31), 'New Year''s Eve' FROM y
  UNION ALL SELECT max(d), 'Memorial Day' FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 5, 1), make_date(y, 5, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM y) WHERE isodow(d) = 1 GROUP BY y
  UNION ALL SELECT min(d), 'Labor Day' FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 9, 1), make_date(y, 9, 30), INTERVAL 1 DAY)) AS DATE) AS d FROM y) WHERE isodow(d) = 1 GROUP BY y
  UNION ALL SELECT min(d), 'Thanksgiving' FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 11, 22), make_date(y, 11, 30), INTERVAL 1 DAY)) AS DATE) AS d FROM y) WHERE isodow(d) = 4 GROUP BY y
  UNION ALL SELECT min(d) + 1, 'Day after Thanksgiving' FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 11, 22), make_date(y, 11, 30), INTERVAL 1 DAY)) AS DATE) AS d FROM y) WHERE isodow(d) = 4 GROUP BY y)"""


@query(f"""{_HOLIDAYS_SQL}
SELECT name, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM docs JOIN h ON abs(date_diff('day', docs.date_created, h.d)) <= 1 GROUP BY name""")
def holiday_timing(m):
    return agg.holiday_timing(m.documents, 1994, 2002)


@query("""
, t AS (SELECT doc_id, count(*) AS k, sum(c) AS s FROM lines GROUP BY doc_id)
SELECT docs.doc_id, docs.project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY date_created NULLS LAST, docs.doc_id) AS BIGINT) AS event, CAST(coalesce(k, 0) AS BIGINT) AS items, CAST(s AS BIGINT) AS item_total_cents FROM docs LEFT JOIN t ON docs.doc_id = t.doc_id""")
def project_timeline(m):
    return agg.project_timeline(m.documents, m.line_items).select("doc_id", "project_id", _l("event"), "items", _c("item_total"))


@query("""
, g AS (SELECT party, strftime(date_created, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY ALL)
SELECT party, month, n FROM g QUALIFY n > 1.25 * avg(n) OVER (PARTITION BY party)""")
def key_periods(m):
    return agg.key_periods(m.documents, factor=1.25).select("party", "month", "n")


@query("""
, g AS (SELECT cost_code, (c / 100.0::DOUBLE - quantity * (uc / 100.0::DOUBLE)) / (quantity * (uc / 100.0::DOUBLE)) * 100 AS m FROM lines WHERE quantity > 0 AND uc > 0)
SELECT cost_code, CAST(count(*) AS BIGINT) AS n, round(min(m), 4) AS low, round(max(m), 4) AS high, round(avg(m), 4) AS mean, var_pop(m) > 5 OR max(m) - min(m) > 10 AS inconsistent FROM g GROUP BY cost_code HAVING count(*) >= 2""")
def markup_variance_by_cost_code(m):
    return agg.markup_variance(m.line_items, ("cost_code",)).select("cost_code", "n", _r(F.col("low"), "low", 4), _r(F.col("high"), "high", 4), _r(F.col("mean"), "mean", 4), "inconsistent")


@query("""
, g AS (SELECT description, count(*) AS n, min(c / 100.0::DOUBLE / quantity) AS low, max(c / 100.0::DOUBLE / quantity) AS high, avg(c / 100.0::DOUBLE / quantity) AS mean, stddev_pop(c / 100.0::DOUBLE / quantity) AS std FROM lines WHERE quantity > 0 GROUP BY description HAVING count(*) >= 2)
SELECT description, CAST(n AS BIGINT) AS n, round(low, 8) AS low, round(high, 8) AS high, round(std / mean, 4) AS cv FROM g WHERE std / mean > 0.2""")
def price_variation_by_description(m):
    return rules.similar_items_prices(m.line_items).select("description", "n", _r(F.col("low"), "low", 8), _r(F.col("high"), "high", 8), _r(F.col("cv"), "cv", 4))


# --- order and windows -----------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, event_type, round((value - mean) / std, 4) AS z FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std FROM events WINDOW w AS (PARTITION BY event_type))
WHERE n >= 5 AND std > 0 AND std >= 0.01 * abs(mean) AND abs((value - mean) / std) > 2.5""", model=False)
def amount_outliers_z(m):
    return sequences.zscore_outliers(m.table("events"), "value", ("event_type",)).select("event_id", "event_type", _r(F.col("z"), "z", 4))


@query("""
, k AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k FROM events WHERE value IS NOT NULL),
q AS (SELECT event_type, max(CASE WHEN k = n // 4 THEN value END) AS q1, max(CASE WHEN k = 3 * n // 4 THEN value END) AS q3 FROM k GROUP BY event_type HAVING max(n) >= 5)
SELECT event_id, k.event_type, round(value, 6) AS value, round(q1, 6) AS q1, round(q3, 6) AS q3 FROM k JOIN q ON k.event_type = q.event_type WHERE q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""")
def amount_outliers_iqr(m):
    o = sequences.iqr_outliers(m.table("events"), "value", ("event_type",), "event_id")
    return o.select("event_id", "event_type", _r(F.col("value"), "value"), _r(F.col("q1"), "q1"), _r(F.col("q3"), "q3"))


def _runs_sql(sign):
    return f"""
, l AS (SELECT project_id, doc_id, date_created, c, CASE WHEN c {sign} lag(c) OVER w AND date_diff('day', lag(date_created) OVER w, date_created) <= 90 THEN 0 ELSE 1 END AS new FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY date_created, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT project_id, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, CAST(min(date_created) AS VARCHAR) AS start, CAST(max(date_created) AS VARCHAR) AS end_date, min(c) AS low_cents, max(c) AS high_cents FROM r GROUP BY project_id, run HAVING count(*) >= 3"""


def _runs(m, increasing):
    r = sequences.monotone_runs(m.documents, ("project_id",), "total", "date_created", "doc_id", increasing)
    return r.select("project_id", _l("run"), "n", _d("start"), F.col("end").cast("string").alias("end_date"), _c("low"), _c("high"))


@query(_runs_sql(">"))
def increasing_runs(m):
    return _runs(m, True)


@query(_runs_sql("<"))
def decreasing_runs(m):
    return _runs(m, False)


@query("""
, d AS (SELECT doc_id, project_id, date_diff('day', lag(date_created) OVER (PARTITION BY project_id ORDER BY date_created, doc_id), date_created) AS gap FROM docs),
s AS (SELECT *, avg(gap) OVER (PARTITION BY project_id) AS mean, stddev_pop(gap) OVER (PARTITION BY project_id) AS std FROM d WHERE gap IS NOT NULL)
SELECT doc_id, project_id, CAST(gap AS BIGINT) AS gap, round(CASE WHEN std > 0 THEN (gap - mean) / std ELSE 0 END, 4) AS z, CASE WHEN std > 0 THEN (gap - mean) / std ELSE 0 END > 2 OR gap > 3 * mean AS unusual FROM s WHERE gap > 60""")
def unusual_gaps(m):
    return sequences.gaps(m.documents).select("doc_id", "project_id", _l("gap"), _r(F.col("z"), "z", 4), "unusual")


@query("""
, w AS (SELECT party, doc_id, date_created, s.size, lead(date_created, s.size - 1) OVER (PARTITION BY party, s.size ORDER BY date_created, doc_id) AS e FROM docs, (SELECT unnest(range(3, 10)) AS size) s),
d AS (SELECT *, date_diff('day', date_created, e) AS span FROM w WHERE e IS NOT NULL)
SELECT party, CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n, round(max(size::DOUBLE / (span + 1)), 6) AS density FROM d WHERE span <= 2 * (size - 1) GROUP BY party, size""")
def event_clusters(m):
    c = sequences.event_clusters(m.documents)
    return c.groupBy("party", "size").agg(F.count(F.lit(1)).alias("n"), F.max("density").alias("density")).select("party", _l("size"), "n", _r(F.col("density"), "density"))


@query("""
, d AS (SELECT *, lag(date_created) OVER w AS pd, lag(doc_type) OVER w AS pt, lag(status) OVER w AS ps, lag(doc_id) OVER w AS pid, lead(doc_id) OVER w AS nid FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id)),
e AS (SELECT project_id, doc_id, 'first' AS event FROM d WHERE pid IS NULL UNION ALL SELECT project_id, doc_id, 'last' FROM d WHERE nid IS NULL UNION ALL SELECT project_id, doc_id, 'gap' FROM d WHERE date_diff('day', pd, date_created) > 30
  UNION ALL SELECT project_id, doc_id, 'type change' FROM d WHERE pt <> doc_type UNION ALL SELECT project_id, doc_id, 'status change' FROM d WHERE ps <> status)
SELECT * FROM e""")
def key_events(m):
    return sequences.key_events(m.documents).select("project_id", "doc_id", "event")


@query("""
, d AS (SELECT *, CASE WHEN lag(doc_type) OVER w = doc_type THEN 0 ELSE 1 END AS new FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY date_created, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT project_id, CAST(run AS BIGINT) AS run, min(doc_type) AS doc_type, CAST(count(*) AS BIGINT) AS length, CAST(min(date_created) AS VARCHAR) AS start FROM r GROUP BY project_id, run""")
def type_runs(m):
    return sequences.run_lengths(m.documents).select("project_id", _l("run"), F.col("value").alias("doc_type"), "length", _d("start"))


@query("""
, d AS (SELECT project_id, sign(c - lag(c) OVER w) * sign(lead(c) OVER w - c) AS t FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id))
SELECT project_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN t < 0 THEN 1 ELSE 0 END) AS BIGINT) AS turns FROM d GROUP BY project_id HAVING count(*) >= 4 AND sum(CASE WHEN t < 0 THEN 1 ELSE 0 END) >= 0.75 * (count(*) - 2)""")
def alternating_amounts(m):
    return sequences.alternating(m.documents)


@query("""
, g AS (SELECT project_id, CAST(day(date_created) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY ALL)
SELECT project_id, day, n FROM g QUALIFY n >= 2 AND n >= 0.3 * sum(n) OVER (PARTITION BY project_id)""")
def same_day_of_month(m):
    return sequences.same_day_of_month(m.documents, least=2).select("project_id", _l("day"), "n")


@query("""
, d AS (SELECT doc_type AS first, lead(doc_type) OVER w AS second, lead(doc_type, 2) OVER w AS third FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id))
SELECT first, second, third, CAST(count(*) AS BIGINT) AS n FROM d WHERE third IS NOT NULL GROUP BY ALL""")
def type_trigrams(m):
    return sequences.type_trigrams(m.documents)


@query("""
, p AS (SELECT project_id, item_id, c, date_created FROM items WHERE doc_type IN ('payment_app', 'invoice')), o AS (SELECT project_id, c, date_created FROM docs WHERE doc_type = 'change_order' AND status <> 'rejected')
SELECT p.project_id, item_id, CAST(count(*) AS BIGINT) AS n, CAST(max(date_diff('day', p.date_created, o.date_created)) AS BIGINT) AS days FROM p JOIN o ON p.project_id = o.project_id AND date_diff('day', p.date_created, o.date_created) > 1 AND abs(p.c - o.c) * 1000 <= 50 * o.c GROUP BY ALL""")
def amounts_before_approval(m):
    return sequences.amounts_before_approval(m.items, m.documents, 50).select("project_id", "item_id", "n", _l("days"))


@query("""
, p AS (SELECT project_id, doc_id, number, c, sum(c) OVER (PARTITION BY project_id ORDER BY number) AS earned FROM docs WHERE doc_type = 'payment_app')
SELECT project_id, doc_id, CAST(earned AS BIGINT) AS earned_cents, CAST(coalesce(lag(earned) OVER (PARTITION BY project_id ORDER BY number), 0) AS BIGINT) AS previous_cents, true AS consistent FROM p""")
def running_totals(m):
    return sequences.running_totals(m.payment_applications).select("project_id", "doc_id", _c("earned"), _c("previous"), "consistent")


@query("""
, s AS (SELECT project_id, doc_id, date_created, count(*) AS parts, sum(c) AS s FROM items WHERE c < 1500000 GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT s.project_id, s.doc_id, parts, s, i.item_id, i.c, row_number() OVER (PARTITION BY s.project_id, s.doc_id ORDER BY abs(i.c - s), i.item_id) AS k FROM s JOIN items i ON s.project_id = i.project_id AND date_diff('day', s.date_created, i.date_created) BETWEEN 1 AND 90 AND abs(i.c - s) * 1000 <= 100 * s)
SELECT project_id, doc_id, CAST(parts AS BIGINT) AS parts, CAST(s AS BIGINT) AS sum_cents, item_id AS later_id, c AS later_cents FROM j WHERE k = 1""")
def combined_amounts(m):
    return sequences.combined_amounts(m.items, most=15_000).select("project_id", "doc_id", "parts", F.col("s").alias("sum_cents"), "later_id", F.col("c").alias("later_cents"))


@query(f"""
WITH RECURSIVE {SQL.strip()},
cand AS MATERIALIZED (SELECT b.project_id, b.item_id AS big, b.c AS whole, s.item_id, s.c, row_number() OVER (PARTITION BY b.project_id, b.item_id, b.c ORDER BY s.c DESC, s.item_id DESC) AS k FROM items b JOIN items s ON b.project_id = s.project_id AND b.c > 5000000 AND s.c > 0 AND s.c < b.c AND date_diff('day', b.date_created, s.date_created) BETWEEN 1 AND 90),
f(project_id, big, whole, k, t, n) AS (SELECT DISTINCT project_id, big, whole, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM cand
  UNION ALL SELECT f.project_id, f.big, f.whole, f.k + 1, CASE WHEN (t + c) * 10 <= f.whole * 11 THEN t + c ELSE t END, CASE WHEN (t + c) * 10 <= f.whole * 11 THEN n + 1 ELSE n END FROM f JOIN cand ON f.project_id = cand.project_id AND f.big = cand.big AND f.whole = cand.whole AND cand.k = f.k + 1),
l AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY project_id, big, whole))
SELECT project_id, big AS item_id, CAST(whole AS BIGINT) AS whole_cents, CAST(t AS BIGINT) AS sum_cents, n FROM l WHERE n >= 2 AND abs(t - whole) * 10 <= whole""", model=False)
def split_amounts(m):
    """A greedy fold; in SQL step by step."""
    return sequences.split_amounts(m.items, least=50_000).select("project_id", F.col("big_id").alias("item_id"), F.col("whole").alias("whole_cents"), F.col("sum").alias("sum_cents"), _l("n"))


_ARITHMETIC_SQL = """
ad AS (SELECT party, item_id, row_number() OVER w AS i, lead(c) OVER w - c AS s, date_diff('day', date_created, lead(date_created) OVER w) AS g FROM items WINDOW w AS (PARTITION BY party ORDER BY date_created, item_id)),
al AS (SELECT party, i, list(s) OVER n AS s, list(g) OVER n AS g FROM ad WINDOW n AS (PARTITION BY party ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
az AS (SELECT party, i, n, list_filter(s[1:n - 1], lambda x: x IS NOT NULL) AS s, g[1:n - 1] AS g FROM al, (SELECT unnest(range(3, 10)) AS n)),
am AS (SELECT *, list_avg(s) AS mean FROM az WHERE len(s) = n - 1),
aw AS MATERIALIZED (SELECT party, CAST(i AS BIGINT) AS first, CAST(n AS BIGINT) AS size, mean, s, g FROM am WHERE mean <> 0 AND list_max(s) - mean <= 0.1::DOUBLE * abs(mean) AND mean - list_min(s) <= 0.1::DOUBLE * abs(mean) AND list_max(g) <= 90)"""


def _greedy_sql(clash):
    """Spans of ranks(party, first, size, k), taken in order of k unless they clash with a taken one (x)."""
    return f"""
taken(party, k, chosen) AS (SELECT DISTINCT party, 0::BIGINT, []::STRUCT(f BIGINT, s BIGINT)[] FROM ranks
  UNION ALL SELECT t.party, t.k + 1, CASE WHEN len(list_filter(chosen, lambda x: {clash})) = 0 THEN list_append(chosen, {{'f': r.first, 's': r.size}}) ELSE chosen END FROM taken t JOIN ranks r ON t.party = r.party AND r.k = t.k + 1),
best AS (SELECT party, unnest(chosen) AS c FROM (SELECT * FROM taken QUALIFY k = max(k) OVER (PARTITION BY party)))"""


@query(f""", {_ARITHMETIC_SQL.strip()}
SELECT party, first, size, round(mean / 100, 4) AS mean_step FROM aw""")
def arithmetic_sequences(m):
    w = sequences.arithmetic_windows(m.items.withColumn("v", cents(F.col("amount"))), ("party",), "v", "date_created", "item_id")
    return w.select("party", _l("first"), _l("size"), _r(F.col("mean_step") / 100, "mean_step", 4))


@query(f"""
WITH RECURSIVE {SQL.strip()}, {_ARITHMETIC_SQL.strip()},
ranks AS MATERIALIZED (SELECT party, first, size, row_number() OVER (PARTITION BY party ORDER BY size DESC, first) AS k FROM aw), {_greedy_sql("least(x.f + x.s, r.first + r.size) > greatest(x.f, r.first)").strip()},
even AS (SELECT best.party, c.f AS first, c.s AS size, CASE WHEN mean > 0 THEN greatest(0, 0.15 * (1 - least(1, 5 * list_var_pop(s) / (mean * mean)))) ELSE 0 END AS steps, CASE WHEN list_avg(g) > 0 THEN greatest(0, 0.15 * (1 - least(1, 5 * list_var_pop(g) / (list_avg(g) * list_avg(g))))) ELSE 0 END AS days FROM best JOIN aw ON best.party = aw.party AND c.f = aw.first AND c.s = aw.size)
SELECT party, first, size, round(least(0.95, least(0.95, 0.5 + 0.3 * least(1, (size - 2) / 8.0::DOUBLE) + steps + days) + 0.1)::DOUBLE, 6) AS confidence FROM even""", model=False)
def chosen_sequences(m):
    """A greedy choice; in SQL step by step."""
    w = sequences.arithmetic_runs(m.items.withColumn("v", cents(F.col("amount"))), ("party",), "v", "date_created", "item_id")
    return w.select("party", _l("first"), _l("size"), _r(F.col("confidence"), "confidence"))


# --- rules -----------------------------------------------------------------------------------------------------------------


@query("""
, r AS (SELECT project_id, item_id, date_created, c FROM items WHERE item_status = 'rejected' OR status = 'rejected')
SELECT r.project_id, r.item_id, CAST(count(*) AS BIGINT) AS n, CAST(min(l.date_created) AS VARCHAR) AS first_later, CASE WHEN bool_or(l.doc_type = 'invoice') THEN 'rejected_amount_in_invoice' ELSE 'reappearing_amount' END AS kind
FROM r JOIN items l ON r.project_id = l.project_id AND abs(r.c - l.c) <= 300 AND l.date_created > r.date_created GROUP BY r.project_id, r.item_id, r.c""")
def reappearing_amounts(m):
    return rules.reappearing_amounts(m.items, tolerance_cents=300).select("project_id", "item_id", "n", _d("first_later"), "kind")


@query("""
, a AS (SELECT cost_code, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS mean FROM lines WHERE c > 0 GROUP BY cost_code)
SELECT item_id, lines.cost_code, c AS amount_cents, round(c / 100.0::DOUBLE / mean, 6) AS ratio FROM lines JOIN a ON lines.cost_code = a.cost_code WHERE c > 10000000 AND c / 100.0::DOUBLE / mean > 1.9""")
def unusually_large_amounts(m):
    return rules.unusually_large(m.line_items, ratio=1.9).select("item_id", "cost_code", _c("amount"), _r(F.col("ratio"), "ratio"))


@query("""
, a AS (SELECT cost_code, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS mean FROM lines WHERE c > 0 GROUP BY cost_code)
SELECT lines.cost_code, CAST(count(*) AS BIGINT) AS n, max(c) AS high_cents, round(max(c) / 100.0::DOUBLE / mean, 6) AS ratio FROM lines JOIN a ON lines.cost_code = a.cost_code WHERE c > 10000000 GROUP BY lines.cost_code, mean""")
def category_average_large_amounts(m):
    return rules.large_amounts(m.line_items).select("cost_code", "n", _c("high"), _r(F.col("ratio"), "ratio"))


@query("""
, s AS (SELECT item_id, least(1.0, CASE WHEN length(trim(description)) < 5 THEN 0.4 WHEN length(trim(description)) < 10 THEN 0.3 ELSE 0 END + CASE WHEN c > 10000000 AND length(trim(description)) < 15 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM lines)
SELECT item_id, round(score, 6) AS score, round(0.6 + 0.3 * score, 6) AS confidence FROM s WHERE score >= 0.6""")
def suspicious_descriptions(m):
    return rules.suspicious_descriptions(m.line_items, 0.6).select("item_id", _r(F.col("score"), "score"), _r(F.col("confidence"), "confidence"))


@query("""
, p AS (SELECT project_id, doc_id, item_id, c, date_created, count(*) AS copies FROM items WHERE doc_type IN ('payment_app', 'invoice') AND c > 500000 GROUP BY ALL), o AS (SELECT project_id, c, date_created, status FROM docs WHERE doc_type = 'change_order')
SELECT p.doc_id, item_id, p.c AS amount_cents, CASE WHEN count(o.status) > 0 THEN 'rejected change order' ELSE 'no change order' END AS kind FROM p LEFT JOIN o ON p.project_id = o.project_id AND o.date_created <= p.date_created AND abs(o.c - p.c) * 1000 <= 10 * p.c
GROUP BY p.doc_id, item_id, p.c HAVING coalesce(sum(CASE WHEN o.status <> 'rejected' THEN 1 END), 0) = 0""")
def missing_change_orders(m):
    return rules.missing_change_orders(m.items, m.documents).select("doc_id", "item_id", _c("amount"), "kind")


@query("""
, s AS (SELECT doc_id, sum(c) AS e FROM lines GROUP BY doc_id),
e AS (SELECT doc_id, 'quantity_price' AS "check", c - quantity * uc AS d FROM lines WHERE quantity > 0 AND uc > 0 UNION ALL SELECT docs.doc_id, 'document_total', c - e FROM docs JOIN s ON docs.doc_id = s.doc_id)
SELECT "check", party, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS benefits, CAST(sum(d) AS BIGINT) AS net_cents, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) >= 3 AS systematic FROM e JOIN docs ON e.doc_id = docs.doc_id WHERE abs(d) > 10 GROUP BY "check", party""")
def math_errors(m):
    return rules.math_error_summary(m.line_items, m.documents).select("check", "party", "n", "benefits", F.col("net").cast("long").alias("net_cents"), "systematic")


@query("""
, p AS (SELECT item_id, description, c / 100.0::DOUBLE / quantity AS price, count(*) OVER w AS n, avg(c / 100.0::DOUBLE / quantity) OVER w AS mean FROM lines WHERE quantity > 0 WINDOW w AS (PARTITION BY description))
SELECT description, CAST(count(*) AS BIGINT) AS n, round(max(price / mean), 4) AS high FROM p WHERE n >= 2 AND (price > 2 * mean OR price < 0.5 * mean) GROUP BY description""")
def outlier_pricing(m):
    return rules.outlier_pricing(m.line_items).groupBy("description").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("price") / F.col("mean")).alias("high")).select("description", "n", _r(F.col("high"), "high", 4))


@query("SELECT doc_id, c AS amount_cents, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, c // 100000 * 100000 AS c FROM lines) GROUP BY doc_id, c HAVING count(*) > 1")
def duplicate_in_document(m):
    rows = m.line_items.withColumn("amount", agg.coarse(F.col("amount"), 1000).cast("decimal(15,2)"))
    return rules.duplicate_in_document(rows).select("doc_id", _c("amount"), "n")


@query("""
, d AS (SELECT *, CASE WHEN date_diff('day', lag(date_created) OVER w, date_created) <= 400 THEN 0 ELSE 1 END AS new FROM docs WHERE doc_type = 'change_order' AND c < 20000000 WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY date_created, doc_id ROWS UNBOUNDED PRECEDING) AS island FROM d)
SELECT project_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS sum_cents FROM r GROUP BY project_id, island HAVING count(*) >= 2 AND sum(c) > 20000000""")
def threshold_bypass(m):
    return rules.threshold_bypass(m.documents, 200_000, 200_000, 400).select("project_id", _l("island"), "n", _c("sum"))


@query("""
, j AS (SELECT o.doc_id AS order_id, p.doc_id AS payment_id, date_diff('day', p.date_created, o.date_created) AS days, row_number() OVER (PARTITION BY o.doc_id ORDER BY date_diff('day', p.date_created, o.date_created), p.doc_id) AS k
  FROM docs o JOIN docs p ON o.project_id = p.project_id AND o.doc_type = 'change_order' AND p.doc_type = 'payment_app' AND date_diff('day', p.date_created, o.date_created) BETWEEN 2 AND 14)
SELECT order_id, payment_id, CAST(days AS BIGINT) AS days FROM j WHERE k = 1""")
def strategic_timing(m):
    return rules.strategic_timing(m.documents).select("order_id", "payment_id", _l("days"))


@query("""
, p AS (SELECT * FROM docs WHERE doc_type = 'payment_app'), o AS (SELECT * FROM docs WHERE doc_type = 'change_order'), n AS (SELECT project_id, count(*) AS payments FROM p GROUP BY 1),
f AS (SELECT p.project_id, count(DISTINCT p.doc_id) AS followed FROM p JOIN o ON p.project_id = o.project_id AND date_diff('day', p.date_created, o.date_created) BETWEEN 0 AND 120 GROUP BY 1)
SELECT n.project_id, CAST(payments AS BIGINT) AS payments, CAST(followed AS BIGINT) AS followed FROM n JOIN f ON n.project_id = f.project_id WHERE followed >= 2 AND followed * 2 >= payments""")
def recurring_follow_ups(m):
    return rules.recurring_follow_ups(m.documents, 120).select("project_id", "payments", "followed")


@query("SELECT doc_id, CAST(date_diff('day', date_created, date_received) AS BIGINT) AS days, CASE WHEN date_received < date_created THEN 'received before created' ELSE 'received late' END AS kind FROM docs WHERE date_diff('day', date_created, date_received) < -5 OR date_diff('day', date_created, date_received) > 30")
def chronological_inconsistencies(m):
    return rules.chronological_inconsistencies(m.documents).select("doc_id", _l("days"), "kind")


@query("""
, s AS (SELECT project_id, c // 10000 AS k, item_id, doc_type, list_distinct(string_split(description, ' ')) AS w FROM items),
j AS (SELECT a.project_id, a.item_id AS a_item_id, b.item_id AS b_item_id, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS alike FROM s a JOIN s b ON a.project_id = b.project_id AND a.k = b.k AND a.item_id < b.item_id AND a.doc_type <> b.doc_type)
SELECT project_id, a_item_id, b_item_id, round(alike, 6) AS alike FROM j WHERE alike BETWEEN 0.1 AND 0.5""")
def scope_inconsistencies(m):
    rows = m.items.withColumn("amount", agg.coarse(F.col("amount")).cast("decimal(15,2)"))
    return rules.scope_inconsistencies(rows).select("project_id", "a_item_id", "b_item_id", _r(F.col("alike"), "alike"))


def _subsets(k: int) -> str:
    """SQL for sets of k orders whose sum is near a rejected one: k nested joins with ascending ids."""
    names = [f"o{i}" for i in range(1, k + 1)]
    joins = " ".join(f"JOIN o {n} ON {n}.project_id = r.project_id AND {n}.doc_id <> r.doc_id" + (f" AND {n}.doc_id > {names[i - 1]}.doc_id" if i else "") for i, n in enumerate(names))
    ids, total = ", ".join(f"{n}.doc_id" for n in names), " + ".join(f"{n}.c" for n in names)
    return f"SELECT r.project_id, r.doc_id AS rejected_id, r.c AS whole, [{ids}] AS parts, {total} AS s FROM r {joins} WHERE abs({total} - r.c) * 1000 <= 50 * r.c"


@query(f"""
, r AS (SELECT * FROM docs WHERE doc_type = 'change_order' AND status = 'rejected' AND c > 10000000), o AS (SELECT * FROM docs WHERE doc_type = 'change_order' AND c < 30000000 AND c > 0),
sets AS ({" UNION ALL ".join(_subsets(k) for k in range(1, 6))}),
terms AS (SELECT doc_id, list_distinct(flatten(list(string_split(lower(description), ' ')))) AS t FROM items GROUP BY doc_id),
about AS (SELECT rejected_id, parts, list_distinct(flatten(list(t))) AS t FROM (SELECT rejected_id, parts, unnest(parts) AS doc_id FROM sets) p JOIN terms ON terms.doc_id = p.doc_id GROUP BY rejected_id, parts)
SELECT project_id, sets.rejected_id, array_to_string(sets.parts, ',') AS parts, CAST(len(sets.parts) AS BIGINT) AS n, CAST(s AS BIGINT) AS sum_cents, round(0.8::DOUBLE + 0.05::DOUBLE * coalesce(len(list_intersect(about.t, terms.t)), 0), 6) AS confidence
FROM sets LEFT JOIN about ON about.rejected_id = sets.rejected_id AND about.parts = sets.parts LEFT JOIN terms ON terms.doc_id = sets.rejected_id""")
def split_rejections(m):
    found = disguised.split_rejections(m.documents, 100_000, 300_000, terms=disguised.description_terms(m.items.filter("doc_type = 'change_order'")))
    return found.select("project_id", "rejected_id", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), "n", "sum_cents", _r(F.col("confidence"), "confidence"))


def _rounded(c: str, unit: int) -> str:
    """SQL for cents to a multiple of unit dollars, halves to the even one."""
    u = unit * 100
    return f"(({c} // {u}) + CASE WHEN 2 * ({c} % {u}) > {u} THEN 1 WHEN 2 * ({c} % {u}) < {u} THEN 0 ELSE ({c} // {u}) % 2 END) * {u}"


def _disguised(amounts: str) -> str:
    """SQL for the pairs of an amounts table (project_id, c): every two amounts of a project, rule after rule."""
    rules = [(f"rounded_{u}", f"b = {_rounded('a', u)} OR a = {_rounded('b', u)}") for u in disguised.ROUNDED_TO]
    rules.append(("fee", "100 * b BETWEEN 105 * a AND 115 * a"))
    for name, factors in (("tax", disguised.TAXED), ("discount", disguised.DISCOUNTED)):
        rules.append((name, " OR ".join(f"abs(a * {f} - b * 10000) < 500000 OR abs(b * {f} - a * 10000) < 500000" for f in factors)))
    rules.append(("near", "(b - a) * 40 <= a + b AND b - a <= 100000"))
    cases = " ".join(f"WHEN {test} THEN '{name}'" for name, test in rules)
    return f"""am AS (SELECT DISTINCT project_id, c FROM {amounts} WHERE c > 0), pr AS (SELECT * FROM (SELECT *, CASE {cases} END AS rule FROM (SELECT x.project_id, x.c AS a, y.c AS b FROM am x JOIN am y ON x.project_id = y.project_id AND x.c < y.c)) WHERE rule IS NOT NULL)"""


@query(f"""
, {_disguised("items")},
ty AS (SELECT project_id, c, list_sort(list(DISTINCT doc_type)) AS t FROM items GROUP BY project_id, c),
tx AS (SELECT DISTINCT project_id, c, list_distinct(string_split(lower(description), ' ')) AS w FROM items),
alike AS (SELECT DISTINCT pr.project_id, a, b FROM pr JOIN tx p ON p.project_id = pr.project_id AND p.c = a JOIN tx q ON q.project_id = pr.project_id AND q.c = b WHERE len(list_intersect(p.w, q.w))::DOUBLE / least(len(p.w), len(q.w)) > 0.3)
SELECT pr.project_id, pr.a, pr.b, rule, s.t <> u.t AS differ, alike.a IS NOT NULL AS alike, round(0.7::DOUBLE + CASE WHEN s.t <> u.t THEN 0.1 ELSE 0 END + CASE WHEN alike.a IS NOT NULL THEN 0.15 ELSE 0 END, 6) AS confidence
FROM pr JOIN ty s ON s.project_id = pr.project_id AND s.c = pr.a JOIN ty u ON u.project_id = pr.project_id AND u.c = pr.b LEFT JOIN alike ON alike.project_id = pr.project_id AND alike.a = pr.a AND alike.b = pr.b""")
def fuzzy_items(m):
    return disguised.fuzzy_items(m.items).select("project_id", "a", "b", "rule", "differ", "alike", _r(F.col("confidence"), "confidence"))


@query(f"""
, {_disguised("docs")},
ty AS (SELECT project_id, c, list_sort(list(DISTINCT doc_type)) AS t, bool_or(status = 'rejected') AS bad FROM docs GROUP BY project_id, c)
SELECT pr.project_id, pr.a, pr.b, rule, s.t <> u.t AS differ, s.bad OR u.bad AS rejected, round(0.75::DOUBLE + CASE WHEN s.t <> u.t THEN 0.1 ELSE 0 END + CASE WHEN s.bad OR u.bad THEN 0.15 ELSE 0 END, 6) AS confidence
FROM pr JOIN ty s ON s.project_id = pr.project_id AND s.c = pr.a JOIN ty u ON u.project_id = pr.project_id AND u.c = pr.b""")
def fuzzy_documents(m):
    return disguised.fuzzy_documents(m.documents).select("project_id", "a", "b", "rule", "differ", "rejected", _r(F.col("confidence"), "confidence"))


@query(f"""
, {_disguised("items").replace("am AS", "ia AS").replace("pr AS", "ip AS").replace("FROM am x JOIN am y", "FROM ia x JOIN ia y")}, {_disguised("docs")},
n AS (SELECT project_id, CAST(sum(i) AS BIGINT) AS item_pairs, CAST(sum(d) AS BIGINT) AS document_pairs FROM (SELECT project_id, 1 AS i, 0 AS d FROM ip UNION ALL SELECT project_id, 0, 1 FROM pr) GROUP BY project_id)
SELECT project_id, item_pairs, document_pairs, round(least(0.95::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * (item_pairs + document_pairs)), 6) AS confidence FROM n""")
def fuzzy_summary(m):
    return disguised.fuzzy_summary(m.items, m.documents).select("project_id", "item_pairs", "document_pairs", _r(F.col("confidence"), "confidence"))


@query("""
, f AS (SELECT item_id, c / 100.0::DOUBLE AS a, length(description) AS l, day(date_created) AS d FROM items), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(l) AS ml, stddev_pop(l) AS sl, avg(d) AS md, stddev_pop(d) AS sd FROM f)
SELECT item_id, round(sqrt(pow((a - ma) / sa, 2) + pow((l - ml) / sl, 2) + pow((d - md) / sd, 2)), 4) AS distance FROM f, s WHERE sqrt(pow((a - ma) / sa, 2) + pow((l - ml) / sl, 2) + pow((d - md) / sd, 2)) >= 3""")
def scaled_distance(m):
    return rules.scaled_distance(m.items).select("item_id", _r(F.col("distance"), "distance", 4))


# --- engine ----------------------------------------------------------------------------------------------------------------


@query("""
SELECT CAST((SELECT count(*) FROM docs) AS BIGINT) AS documents, CAST((SELECT count(DISTINCT project_id) FROM docs) AS BIGINT) AS projects, CAST(count(*) AS BIGINT) AS items, CAST(sum(c) AS BIGINT) AS total_cents, CAST(sum(CASE WHEN item_status = 'rejected' THEN c END) AS BIGINT) AS rejected_cents,
  round(CAST(sum(CASE WHEN item_status = 'rejected' THEN c END) AS DOUBLE) / CAST(sum(c) AS DOUBLE) * 100, 6) AS rejected_percent FROM lines""")
def summary_stats(m):
    return engine.summary(m.documents, m.line_items).select("documents", "projects", "items", _c("total"), _c("rejected"), _r(F.col("rejected_percent"), "rejected_percent"))


def _jaccard_sql(a, b):
    return f"coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _word_set_sql(text):
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda x: x <> ''))"


_REAPPEARED_SQL = f"""
rejected AS (SELECT project_id, item_id, date_created, c, {_word_set_sql('description')} AS w FROM items WHERE item_status = 'rejected' OR status = 'rejected'),
again AS (SELECT r.item_id, r.project_id, r.c, bool_or(l.doc_type = 'invoice') AS invoice, avg({_jaccard_sql('r.w', _word_set_sql('l.description'))}) AS alike FROM rejected r JOIN items l ON r.project_id = l.project_id AND abs(r.c - l.c) <= 1 AND l.date_created > r.date_created GROUP BY r.item_id, r.project_id, r.c),
reappeared AS (SELECT item_id, CASE WHEN invoice THEN 0.9 ELSE 0.75 + CASE WHEN alike > 0.8 THEN -0.15 WHEN alike < 0.3 THEN 0.15 ELSE 0 END END::DOUBLE AS confidence FROM again)"""
_UNBACKED_SQL = """
billed AS (SELECT project_id, doc_id, item_id, description, c, date_created, count(*) AS copies FROM items WHERE doc_type IN ('payment_app', 'invoice') AND c > 500000 GROUP BY ALL), orders_ AS (SELECT project_id, c, date_created, status FROM docs WHERE doc_type = 'change_order'),
unbacked AS (SELECT b.item_id, least(0.95, 0.8 + CASE WHEN b.c > 1000000 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(b.description), '\\b(add|extra|additional|new|change|modify)\\b') THEN 0.05 ELSE 0 END)::DOUBLE AS confidence
  FROM billed b LEFT JOIN orders_ o ON b.project_id = o.project_id AND o.date_created <= b.date_created AND abs(o.c - b.c) * 1000 <= 10 * b.c GROUP BY b.doc_id, b.item_id, b.description, b.c HAVING coalesce(sum(CASE WHEN o.status <> 'rejected' THEN 1 END), 0) = 0)"""


@query(f""", {_REAPPEARED_SQL.strip()},
w AS (SELECT DISTINCT c // 100 AS k, {_word_set_sql('description')} AS d FROM items WHERE c > 0), j AS (SELECT a.k, min({_jaccard_sql('a.d', 'b.d')}) AS low FROM w a JOIN w b ON a.k = b.k GROUP BY a.k),
g AS (SELECT c // 100 AS k, count(*) AS n, count(DISTINCT doc_type) AS types, count(DISTINCT party) AS parties FROM items WHERE c > 0 GROUP BY 1 HAVING count(*) > 2),
recurring AS (SELECT CAST(g.k AS VARCHAR) AS subject, least(0.95, 0.7 + 0.1 * least(1.0, n / 5.0::DOUBLE) + 0.1 * least(1.0, types / 3.0::DOUBLE) + CASE WHEN low >= 0.6 THEN 0 ELSE 0.15 END + CASE WHEN parties > 1 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence FROM g JOIN j ON g.k = j.k WHERE types > 1 OR parties > 1 OR low < 0.6),
mk AS (SELECT cost_code, (c / 100.0::DOUBLE - quantity * (uc / 100.0::DOUBLE)) / (quantity * (uc / 100.0::DOUBLE)) * 100 AS m FROM items WHERE quantity > 0 AND uc > 0),
markups AS (SELECT cost_code AS subject, least(0.95, 0.7 + least(0.15, var_pop(m) / 100) + least(0.1, (max(m) - min(m)) / 100) + least(0.1, 0.02 * (count(*) - 2)))::DOUBLE AS confidence FROM mk GROUP BY cost_code HAVING count(*) >= 2 AND (var_pop(m) > 5 OR max(m) - min(m) > 10)),
gd AS (SELECT doc_id, project_id, date_diff('day', lag(date_created) OVER (PARTITION BY project_id ORDER BY date_created, doc_id), date_created) AS gap FROM docs),
gs AS (SELECT *, avg(gap) OVER (PARTITION BY project_id) AS mean, stddev_pop(gap) OVER (PARTITION BY project_id) AS std FROM gd WHERE gap IS NOT NULL),
gz AS (SELECT *, CASE WHEN std > 0 THEN (gap - mean) / std ELSE 0 END AS z FROM gs), far AS (SELECT CAST(doc_id AS VARCHAR) AS subject, (0.7 + least(z / 5, 0.25))::DOUBLE AS confidence FROM gz WHERE gap > 60 AND (z > 2 OR gap > 3 * mean)),
early AS (SELECT p.item_id AS subject, (0.7 + least(max(date_diff('day', p.date_created, o.date_created)) / 30.0::DOUBLE, 0.2) + least(count(*) / 2.0::DOUBLE, 0.1))::DOUBLE AS confidence FROM items p JOIN docs o ON p.project_id = o.project_id AND p.doc_type IN ('payment_app', 'invoice') AND o.doc_type = 'change_order' AND o.status <> 'rejected' AND date_diff('day', p.date_created, o.date_created) > 1 AND abs(p.c - o.c) * 1000 <= 10 * o.c GROUP BY p.project_id, p.item_id),
f AS (SELECT 'recurring_amount' AS kind, * FROM recurring UNION ALL SELECT 'reappearing_amount', * FROM reappeared UNION ALL SELECT 'inconsistent_markup', * FROM markups UNION ALL SELECT 'unusual_gap', * FROM far UNION ALL SELECT 'amount_before_approval', * FROM early)
SELECT kind, subject, round(confidence, 6) AS confidence FROM f WHERE confidence >= 0.7""")
def suspicious_patterns(m):
    return engine.suspicious_patterns(m.documents, m.items).select("kind", "subject", _r(F.col("confidence"), "confidence"))


@query(f""", {_REAPPEARED_SQL.strip()}, {_UNBACKED_SQL.strip()},
f AS (SELECT item_id, 'reappeared' AS why, confidence FROM reappeared UNION ALL SELECT item_id, 'missing change order', confidence FROM unbacked)
SELECT item_id, why, round(confidence, 6) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, why DESC) = 1""")
def disputed_amounts(m):
    return engine.disputed_amounts(m.items, m.documents).select("item_id", "why", _r(F.col("confidence"), "confidence"))


# --- relations and graphs --------------------------------------------------------------------------------------------------

_PAIRS_SQL = """
pairs AS (SELECT a.project_id, a.doc_id AS ai, b.doc_id AS bi, a.doc_type AS t, b.doc_type AS u, a.status AS s, b.status AS v, a.number AS n, b.number AS k, a.file_name AS f, b.file_name AS g, date_diff('day', a.date_created, b.date_created) AS days
  FROM docs a JOIN docs b ON a.project_id = b.project_id AND (a.date_created < b.date_created OR (a.date_created = b.date_created AND a.doc_id < b.doc_id))),
ways AS (SELECT ai AS x, bi AS y, t, u, s, v FROM pairs UNION ALL SELECT bi, ai, u, t, v, s FROM pairs),
rel AS (
  SELECT x AS src, y AS dst, CASE WHEN v = 'rejected' THEN 'rejection' ELSE 'correspondence' END AS kind FROM ways WHERE t = 'change_order' AND u = 'correspondence'
  UNION ALL SELECT x, y, 'referenced_in' FROM ways WHERE t IN ('change_order', 'invoice') AND u = 'payment_app'
  UNION ALL SELECT x, y, 'rejected_reappearing' FROM ways WHERE t = 'change_order' AND s = 'rejected' AND u IN ('payment_app', 'invoice')
  UNION ALL SELECT x, y, 'related_invoice' FROM ways WHERE t <> 'invoice' AND u = 'invoice'
  UNION ALL SELECT ai, bi, 'sequential' FROM pairs WHERE t = u AND t IN ('payment_app', 'change_order') AND k = n + 1
  UNION ALL SELECT ai, bi, 'revision' FROM pairs WHERE t = u AND t NOT IN ('payment_app', 'change_order') AND days <= 30 AND regexp_matches(g, 'rev|version|update') AND NOT regexp_matches(f, 'rev|version|update')
  UNION ALL SELECT ai, bi, 'approval' FROM pairs WHERE t = 'change_order' AND u = 'correspondence' AND days <= 30
  UNION ALL SELECT ai, bi, 'parent_child' FROM pairs WHERE t <> u AND days <= 30 AND NOT (t = 'change_order' AND u = 'correspondence') AND NOT (u = 'change_order' AND t = 'correspondence'))"""


@query(f", {_PAIRS_SQL.strip()}\nSELECT src AS source_doc_id, dst AS target_doc_id, kind AS relationship_type FROM rel")
def document_relationships(m):
    return relationships.pair_rules(m.documents).select("source_doc_id", "target_doc_id", "relationship_type")


@query(f""", {_PAIRS_SQL.strip()},
e AS (SELECT src AS s, dst AS t FROM rel UNION SELECT dst, src FROM rel), one AS (SELECT DISTINCT t AS d, 1 AS depth FROM e WHERE s = 14), two AS (SELECT DISTINCT e.t AS d, 2 AS depth FROM one JOIN e ON one.d = e.s)
SELECT d AS doc_id, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE d <> 14 GROUP BY d""")
def two_hop_network(m):
    return relationships.two_hops(relationships.pair_rules(m.documents), 14).select("doc_id", _l("depth"))


def _edges(m):
    return graph.document_edges(relationships.pair_rules(m.documents), part="project_id")


_EDGES_SQL = _PAIRS_SQL.strip() + ",\ne AS MATERIALIZED (SELECT DISTINCT src, dst FROM rel)"
_DEEPEST = 12


def _distance_sql():
    """Pairs at each distance with their number of shortest paths, up to a distance that no pair here has."""
    out = ", d1 AS MATERIALIZED (SELECT src AS s, dst AS t, 1.0::DOUBLE AS paths FROM e)"
    for d in range(2, _DEEPEST + 1):
        before = " UNION ALL ".join(f"SELECT s, t FROM d{k}" for k in range(1, d))
        out += f", d{d} AS MATERIALIZED (SELECT s, dst AS t, sum(paths) AS paths FROM d{d - 1} JOIN e ON t = src WHERE s <> dst AND (s, dst) NOT IN ({before}) GROUP BY s, dst)"
    return out + ", dist AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, t, paths, {d} AS d FROM d{d}" for d in range(1, _DEEPEST + 1)) + ")"


@query(f""", {_EDGES_SQL}
, d AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(count(*) AS BIGINT) AS degree FROM d GROUP BY id""")
def degree_centrality(m):
    return graph.degrees(_edges(m))


@query(f""", {_EDGES_SQL}
SELECT doc_id AS id FROM docs WHERE doc_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def isolated_documents(m):
    return graph.isolated(m.documents.select(F.col("doc_id").alias("id")), _edges(m))


@query(f"""
WITH RECURSIVE {SQL.strip()}, {_EDGES_SQL},
und AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(a, b) AS (SELECT a, a FROM und UNION SELECT reach.a, und.b FROM reach JOIN und ON reach.b = und.a)
SELECT a AS id, min(b) AS root, CAST(count(*) AS BIGINT) AS size FROM reach GROUP BY a""", model=False)
def components(m):
    return graph.clusters(_edges(m)).select("id", "root", "size")


@query(f""", {_PAIRS_SQL.strip()}, e AS (SELECT DISTINCT src, dst FROM rel),
c AS (SELECT [a.src, a.dst] AS p FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
  UNION ALL SELECT [a.src, a.dst, b.dst] FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT array_to_string(p, '>') AS cycle FROM c""")
def circular_references(m):
    return graph.cycles(_edges(m), 3).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("cycle"))


@query(f""", {_EDGES_SQL}{_distance_sql()}
SELECT s AS id, CAST(count(*) AS BIGINT) AS reached, round(count(*)::DOUBLE / sum(d), 6) AS closeness FROM dist GROUP BY s""")
def closeness_centrality(m):
    return graph.closeness(_edges(m)).select("id", "reached", _r(F.col("closeness"), "closeness"))


def _rank_sql():
    out = ", v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), deg AS (SELECT src, count(*) AS k FROM e GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM v)"
    out += ", r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"
    for k in range(1, 11):
        out += f", g{k} AS (SELECT dst, sum(rank / k) AS got FROM e JOIN r{k - 1} ON src = id JOIN deg ON deg.src = e.src GROUP BY dst), l{k} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{k - 1} WHERE id NOT IN (SELECT src FROM deg))"
        out += f", r{k} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n) AS rank FROM v LEFT JOIN g{k} ON id = dst, n, l{k})"
    return out


@query(f""", {_EDGES_SQL}{_rank_sql()}
SELECT id, round(rank, 12) AS rank FROM r10""")
def pagerank(m):
    return graph.pagerank(_edges(m), 10).select("id", _r(F.col("rank"), "rank", 12))


@query(f""", {_PAIRS_SQL.strip()},
best AS MATERIALIZED (SELECT src AS s, dst AS t FROM rel WHERE kind IN ('parent_child', 'revision', 'sequential') QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE kind WHEN 'sequential' THEN 1 WHEN 'revision' THEN 2 ELSE 3 END, dst) = 1),
c1 AS (SELECT [s, t] AS c FROM best), c2 AS (SELECT CASE WHEN t IS NULL OR list_contains(c, t) THEN c ELSE list_append(c, t) END AS c FROM c1 LEFT JOIN best ON c[-1] = s),
c3 AS (SELECT CASE WHEN t IS NULL OR list_contains(c, t) THEN c ELSE list_append(c, t) END AS c FROM c2 LEFT JOIN best ON c[-1] = s)
SELECT array_to_string(c, '>') AS chain FROM c3""")
def relationship_chains(m):
    return relationships.chains(relationships.pair_rules(m.documents)).select(F.concat_ws(">", F.transform("chain", lambda x: x.cast("string"))).alias("chain"))


# --- text and vectors ------------------------------------------------------------------------------------------------------

_ASKED = "vec_id % 20 = 0"
_UNIT = "list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])))"
_SCORES = f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS y FROM embeddings WHERE {_ASKED}), s AS (SELECT query_id, vec_id, CAST(label AS BIGINT) AS label, round({_UNIT}, 10) AS score FROM (SELECT query_id, vec_id, label, embedding AS x, y FROM embeddings, q))"""


def _asked(m):
    return m.table("embeddings").filter(_ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""{_SCORES.strip()}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""", model=False)
def vector_top_k(m):
    """The queries are all vectors whose id is divisible by 20, against all."""
    return search.vector_ranks(m.table("embeddings"), _asked(m), 10).select("query_id", _l("rank"), "vec_id", _r(F.col("score"), "score"))


@query(f"""{_SCORES.strip()}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s WHERE label IN (1, 2, 3) AND score >= 0 QUALIFY rank <= 10""", model=False)
def vector_filtered(m):
    v = search.filtered(m.table("embeddings"), {"label": [1, 2, 3]})
    return search.vector_ranks(v, _asked(m), 10, 0.0).select("query_id", _l("rank"), "vec_id", _r(F.col("score"), "score"))


_KEYWORDS = """t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: x = 'with')) AS a, len(list_filter(w, lambda x: x = 'there')) AS b FROM t),
k AS (SELECT doc_id, CAST((a > 0)::INT + (b > 0)::INT AS BIGINT) AS found, CAST(a + b AS BIGINT) AS hits, CAST(words AS BIGINT) AS words, ((a > 0)::INT + (b > 0)::INT) / 2.0::DOUBLE + 0.01::DOUBLE * (a + b) / words AS score FROM c WHERE a + b > 0)"""


@query(f"""
WITH {_KEYWORDS}
SELECT doc_id, found, hits, words, round(score, 6) AS score FROM k""", model=False)
def keyword_search(m):
    return search.keyword_scores(m.table("documents"), "there with").select("doc_id", _l("found"), _l("hits"), _l("words"), _r(F.col("score"), "score"))


@query(f"""{_SCORES.strip()}, {_KEYWORDS},
a AS (SELECT query_id, vec_id AS doc_id, score, 'vector' AS how FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20), b AS (SELECT doc_id, score FROM k ORDER BY k.score DESC, doc_id LIMIT 20),
g AS (SELECT query_id, doc_id, max(score) AS score, string_agg(DISTINCT how, '+' ORDER BY how) AS how FROM (SELECT * FROM a UNION ALL SELECT query_id, doc_id, score, 'keyword' FROM q, b) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, how FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g.score DESC, doc_id) <= 10""", model=False)
def hybrid_search(m):
    return search.hybrid_search(m.table("documents"), m.table("embeddings"), "there with", _asked(m)).select("query_id", "doc_id", _r(F.col("score"), "score"), "how")


@query("""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z][A-Z ]{3,}:?$')) AS h, len(regexp_extract_all(text, '(?m)^\\s*(?:[-*•]|\\d+\\.)\\s')) AS l, len(regexp_extract_all(text, '\\|.+\\|')) AS t, len(regexp_extract_all(text, '\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b')) AS d, len(regexp_extract_all(text, '\\$\\s?\\d[\\d,]*(?:\\.\\d\\d)?')) AS m, len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?%')) AS p FROM documents)
SELECT doc_id, 'table' AS marker, CAST(t AS BIGINT) AS n, round(t * 1.3, 6)::DOUBLE AS score FROM c WHERE t > 0 UNION ALL SELECT doc_id, 'date', d, round(d * 1.4, 6) FROM c WHERE d > 0 UNION ALL SELECT doc_id, 'currency', m, round(m * 1.8, 6) FROM c WHERE m > 0 UNION ALL SELECT doc_id, 'percent', p, round(p * 1.5, 6) FROM c WHERE p > 0
UNION ALL SELECT doc_id, 'header', h, round(h * 1.5, 6) FROM c WHERE h > 0 UNION ALL SELECT doc_id, 'list', l, round(l * 1.2, 6) FROM c WHERE l > 0""", model=False)
def important_content(m):
    return search.markers(m.table("documents")).select("doc_id", "marker", _l("n"), _r(F.col("score"), "score"))


def _chunk_sql():
    """Step by step: a piece ends behind the last paragraph, sentence or word that ends in its second half."""
    behind = lambda mark, n: f"CASE WHEN strpos(reverse(w), '{mark[::-1]}') > 0 THEN lo + length(w) - strpos(reverse(w), '{mark[::-1]}') + 1 END".replace("\n", "' || chr(10) || '")
    stop = f"coalesce({behind(chr(10) * 2, 2)}, {behind('. ', 2)}, {behind(' ', 1)}, hi)"
    step = lambda source, at: f"SELECT doc_id, pos, CASE WHEN hi < n THEN {stop} ELSE hi END AS stop, n FROM (SELECT *, substring(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)) AS w FROM (SELECT d.doc_id, {at} AS pos, least(d.n, {at} + 1000) AS hi, {at} + 500 AS lo, d.n, d.text FROM {source}))"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c(doc_id, pos, stop, n) AS ({step("d", "0::BIGINT")} UNION ALL {step("c JOIN d ON c.doc_id = d.doc_id AND c.stop < c.n", "greatest(c.stop - 200, c.pos + 1)")}),
p AS (SELECT c.doc_id, pos, regexp_replace(substring(text, CAST(pos + 1 AS BIGINT), CAST(stop - pos AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS piece FROM c JOIN d ON c.doc_id = d.doc_id)
SELECT doc_id, row_number() OVER w - 1 AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS total_chunks, CAST(length(piece) AS BIGINT) AS chunk_length, md5(piece) AS chunk_md5 FROM p WHERE length(piece) >= 50 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""


@query(_chunk_sql(), model=False)
def text_chunks(m):
    return search.chunks(m.table("documents")).select("doc_id", _l("chunk_index"), _l("total_chunks"), _l("chunk_length"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day FROM events GROUP BY ALL", model=False)
def event_bursts(m):
    from tallyforge.streaming.ingest import bursts

    return bursts(m.table("events"), length="1 day", slide="1 day").select("event_type", "n", F.date_format("start", "yyyy-MM-dd").alias("day"))


# --- detectors over relations ----------------------------------------------------------------------------------------------


@query("""
, j AS (SELECT i.project_id, item_id, o.doc_id AS order_id, date_diff('day', i.date_created, o.date_created) AS days, row_number() OVER (PARTITION BY i.project_id, item_id ORDER BY date_diff('day', i.date_created, o.date_created), o.doc_id) AS k
  FROM items i JOIN docs o ON i.project_id = o.project_id AND i.doc_type IN ('payment_app', 'invoice') AND o.doc_type = 'change_order' AND o.status = 'approved' AND o.date_created > i.date_created AND abs(i.c - o.c) * 1000 <= 50 * o.c)
SELECT project_id, item_id, order_id, CAST(days AS BIGINT) AS days FROM j WHERE k = 1""")
def premature_billing(m):
    return detectors.premature_billing(m.items, m.documents, 50).select("project_id", "item_id", "order_id", _l("days"))


@query(f""", {_PAIRS_SQL.strip()}
SELECT kind AS relationship_type, a.status AS source_status, CAST(count(*) AS BIGINT) AS n FROM rel JOIN docs a ON a.doc_id = src JOIN docs b ON b.doc_id = dst WHERE (a.status = 'approved' AND b.status = 'rejected') OR (a.status = 'rejected' AND b.status = 'approved') GROUP BY ALL""")
def contradictory_approvals(m):
    return detectors.contradictory_approvals(m.documents, relationships.pair_rules(m.documents)).groupBy("relationship_type", "source_status").agg(F.count(F.lit(1)).alias("n"))


@query(f""", {_PAIRS_SQL.strip()}
SELECT item_id, items.doc_id, description FROM items WHERE doc_type = 'payment_app' AND regexp_matches(lower(description), 'ring|plate') AND doc_id NOT IN (SELECT dst FROM rel WHERE kind = 'referenced_in')""")
def missing_documentation(m):
    return detectors.missing_documentation(m.items, relationships.pair_rules(m.documents), "ring|plate").select("item_id", "doc_id", "description")


@query(f""", {_PAIRS_SQL.strip()}, r AS (SELECT DISTINCT src FROM rel WHERE kind = 'rejection')
SELECT a.project_id, a.item_id AS rejected_id, b.item_id AS other_id FROM items a JOIN r ON a.doc_id = r.src JOIN items b ON a.project_id = b.project_id AND a.doc_id <> b.doc_id AND abs(a.c - b.c) * 1000 <= 10 * a.c""")
def rejected_scope(m):
    return detectors.rejected_scope(m.items, relationships.pair_rules(m.documents)).select("project_id", "rejected_id", "other_id")


def _restoration_sql():
    from tallyforge.functions.texts import SUBSTITUTIONS, TECHNICAL

    terms = "[" + ", ".join(f"'{t}'" for t in TECHNICAL) + "]"
    has = lambda t, x: f"contains({t}, '{x}')"
    pair = " OR ".join(f"({has('r.p', x)} AND {has('o.p', y)} AND NOT {has('o.p', x)}) OR ({has('r.p', y)} AND {has('o.p', x)} AND NOT {has('o.p', y)})" for x, y in SUBSTITUTIONS)
    grams = "list_distinct([concat_ws(' ', w0[i], w0[i + 1]) for i in range(1, len(w0))])"
    return f"""
, t AS (SELECT doc_id, string_agg(description, ' ' ORDER BY description) AS text FROM (SELECT DISTINCT doc_id, description FROM items WHERE doc_type = 'change_order') GROUP BY doc_id),
x AS (SELECT docs.project_id, docs.doc_id, status, date_created, c, lower(text) AS p, string_split(lower(text), ' ') AS w0 FROM docs JOIN t ON docs.doc_id = t.doc_id WHERE doc_type = 'change_order'),
y AS (SELECT *, list_distinct(w0) AS w, {grams} AS g, list_intersect(list_distinct(w0), {terms}) AS k FROM x),
j AS (SELECT r.project_id, r.doc_id AS rejected_id, r.c AS rc, o.c, 0.3::DOUBLE * {_jaccard_sql('r.w', 'o.w')} + 0.2::DOUBLE * {_jaccard_sql('r.g', 'o.g')} + 0.2::DOUBLE * {_jaccard_sql('r.k', 'o.k')} + CASE WHEN {pair} THEN 0.3 ELSE 0 END::DOUBLE AS alike
  FROM y r JOIN y o ON r.project_id = o.project_id AND r.status = 'rejected' AND o.status <> 'rejected' AND o.date_created > r.date_created)
SELECT project_id, rejected_id, CAST(count(*) AS BIGINT) AS orders, round(max(alike), 6) AS alike, CAST(sum(c) AS BIGINT) AS restored_cents, round(sum(c) * 100.0::DOUBLE / rc, 6) AS percent FROM j WHERE alike >= 0.1 GROUP BY project_id, rejected_id, rc"""


@query(_restoration_sql())
def scope_restoration(m):
    return detectors.scope_restoration(m.documents, m.items, 0.1).select("project_id", "rejected_id", "orders", _r(F.col("alike"), "alike"), F.col("restored").alias("restored_cents"), _r(F.col("percent"), "percent"))


@query("""
, k AS (SELECT doc_id, CAST(sum(c) AS DOUBLE) * 100.0::DOUBLE / CAST(sum(quantity * uc) AS DOUBLE) - 100 AS markup FROM items WHERE doc_type = 'change_order' AND quantity > 0 AND uc > 0 GROUP BY doc_id),
f AS (SELECT docs.project_id, docs.doc_id, markup, first(markup) OVER (PARTITION BY project_id ORDER BY date_created, docs.doc_id) AS first_markup FROM docs JOIN k ON docs.doc_id = k.doc_id)
SELECT project_id, doc_id, round(markup, 4) AS markup, round(first_markup, 4) AS first_markup FROM f WHERE abs(markup - first_markup) > 2""")
def markup_changes(m):
    return detectors.markup_changes(m.documents, m.items).select("project_id", "doc_id", _r(F.col("markup"), "markup", 4), _r(F.col("first_markup"), "first_markup", 4))


@query(f""", {_PAIRS_SQL.strip()}, e AS (SELECT DISTINCT src, dst FROM rel)
SELECT a.src AS source_doc_id, a.dst AS target_doc_id FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""")
def mutual_references(m):
    return detectors.mutual_references(relationships.pair_rules(m.documents)).select("source_doc_id", "target_doc_id")


@query("""
, n AS (SELECT doc_id AS first, lead(doc_id) OVER w AS second, lead(doc_id, 2) OVER w AS third, c + lead(c) OVER w + lead(c, 2) OVER w AS sum_cents FROM docs WHERE doc_type = 'change_order' WINDOW w AS (PARTITION BY project_id ORDER BY number))
SELECT * FROM n WHERE third IS NOT NULL""")
def sequential_change_orders(m):
    return detectors.sequential_chains(relationships.pair_rules(m.documents), m.documents)


@query(f""", {_EDGES_SQL}{_distance_sql()}
SELECT a.t AS id, round(sum(a.paths * b.paths / c.paths), 6) AS betweenness FROM dist a JOIN dist b ON a.t = b.s AND a.s <> b.t JOIN dist c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY a.t""")
def betweenness_centrality(m):
    return graph.betweenness(_edges(m)).select("id", _r(F.col("betweenness"), "betweenness"))


def _eigen_sql():
    out = ", v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS score FROM v)"
    for k in range(1, 11):
        out += f", y{k} AS MATERIALIZED (SELECT x.id, x.score + coalesce(got, 0) AS score FROM x{k - 1} x LEFT JOIN (SELECT dst, sum(score) AS got FROM e JOIN x{k - 1} ON src = id GROUP BY dst) ON x.id = dst)"
        out += f", x{k} AS MATERIALIZED (SELECT id, score / (SELECT sqrt(sum(score * score)) FROM y{k}) AS score FROM y{k})"
    return out


@query(f""", {_EDGES_SQL}{_eigen_sql()}
SELECT id, round(score, 9) AS score FROM x10""")
def eigenvector_centrality(m):
    return graph.eigenvector(_edges(m), 10).select("id", _r(F.col("score"), "score", 9))


@query(f"""
WITH RECURSIVE {SQL.strip()},
pl AS (SELECT party, doc_id, date_created, row_number() OVER (PARTITION BY party ORDER BY date_created, doc_id) - 1 AS first FROM docs),
pw AS (SELECT pl.*, s.size, lead(date_created, s.size - 1) OVER (PARTITION BY party, s.size ORDER BY first) AS e FROM pl, (SELECT unnest(range(3, 10)) AS size) s),
pc AS (SELECT party, doc_id, first, size, date_diff('day', date_created, e) AS span FROM pw WHERE e IS NOT NULL AND date_diff('day', date_created, e) <= 2 * (size - 1)),
pb AS MATERIALIZED (SELECT *, 0.7::DOUBLE + least(0.2::DOUBLE * (size / (span + 1)::DOUBLE - 1), 0.25) AS confidence FROM pc QUALIFY row_number() OVER (PARTITION BY party, doc_id ORDER BY 0.7::DOUBLE + least(0.2::DOUBLE * (size / (span + 1)::DOUBLE - 1), 0.25) DESC, size DESC) = 1),
ranks AS MATERIALIZED (SELECT party, first, size, row_number() OVER (PARTITION BY party ORDER BY confidence DESC, size DESC, first) AS k FROM pb),
{_greedy_sql("least(x.f + x.s, r.first + r.size) - greatest(x.f, r.first) > 0 AND 2 * (least(x.f + x.s, r.first + r.size) - greatest(x.f, r.first)) >= least(x.s, r.size)").strip()}
SELECT best.party, doc_id, CAST(size AS BIGINT) AS size, CAST(span AS BIGINT) AS span, round(confidence, 6) AS confidence FROM best JOIN pb ON best.party = pb.party AND c.f = pb.first AND c.s = pb.size""", model=False)
def chosen_clusters(m):
    """A greedy choice; in SQL step by step."""
    c = sequences.best_event_clusters(m.documents).select("party", "doc_id", "first", "size", "span", "confidence")
    best = detectors.drop_overlaps(c, ("party",), "first", "size", [F.desc("confidence"), F.desc("size")])
    return best.select("party", "doc_id", _l("size"), _l("span"), _r(F.col("confidence"), "confidence"))


# --- writing rules, evidence and features ----------------------------------------------------------------------------------


@query("SELECT project_id, doc_type, doc_id, status FROM docs QUALIFY row_number() OVER (PARTITION BY project_id, doc_type ORDER BY doc_id DESC) = 1")
def latest_documents(m):
    return upserts.latest(m.documents.select("project_id", "doc_type", "doc_id", "status"), ("project_id", "doc_type"), "doc_id")


@query("""
SELECT project_id, CAST(max_by(c, CASE WHEN doc_type = 'invoice' THEN doc_id END) AS BIGINT) AS invoice_cents, max_by(status, CASE WHEN doc_type = 'contract' THEN doc_id END) AS contract_status, max(doc_id) AS doc_id FROM docs GROUP BY project_id""")
def merged_versions(m):
    rows = m.documents.select("project_id", "doc_id", F.when(F.col("doc_type") == "invoice", cents(F.col("total"))).alias("invoice_cents"), F.when(F.col("doc_type") == "contract", F.col("status")).alias("contract_status"))
    return upserts.merged(rows, ("project_id",), "doc_id")


@query("""
, known AS (SELECT project_id, doc_type, doc_id FROM docs WHERE date_created < DATE '1994-01-01')
SELECT * FROM known UNION ALL SELECT project_id, doc_type, min(doc_id) AS doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project_id = d.project_id AND k.doc_type = d.doc_type) GROUP BY ALL""")
def registered_documents(m):
    rows = m.documents.select("project_id", "doc_type", "doc_id", "date_created")
    return upserts.insert_absent(rows.filter("date_created < DATE'1994-01-01'").drop("date_created"), rows.drop("date_created"), ("project_id", "doc_type"), "doc_id")


@query("SELECT CASE WHEN doc_type = 'invoice' AND status = 'rejected' THEN 'deleted' ELSE status END AS status, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY ALL")
def soft_deleted(m):
    return upserts.soft_delete(m.documents, m.documents.filter("doc_type = 'invoice' AND status = 'rejected'")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_status, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS total_cents FROM items WHERE status <> 'rejected' GROUP BY item_status")
def hard_deleted(m):
    left = upserts.hard_delete({"items": m.line_items}, m.documents.filter("status = 'rejected'"))["items"]
    return left.groupBy("item_status").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("amount"))).alias("total_cents"))


@query("""
SELECT item_id AS subject, doc_id, 'evidence_' || row_number() OVER (ORDER BY quantity DESC, item_id) AS evidence, description || ' for $' || format('{:,.2f}', c / 100.0::DOUBLE) || ' in document ' || doc_id AS citation FROM lines WHERE quantity >= 49""")
def evidence_for_items(m):
    found = engine.finding(m.line_items.filter("quantity >= 49"), "large_quantity", "item_id", "quantity")
    return reports.evidence(found, m.line_items).select("subject", "doc_id", "evidence", "citation")


@query("SELECT item_id, doc_id, c / 100.0::DOUBLE AS amount, 1::BIGINT AS has_quantity, 1::BIGINT AS has_price, CAST(length(description) AS BIGINT) AS length, CASE WHEN c % 100000 = 0 THEN 1 ELSE 0 END::BIGINT AS round, CAST(day(date_created) AS BIGINT) AS day FROM items")
def item_features(m):
    return rules.features(m.items).select("item_id", "doc_id", "amount", *map(_l, ("has_quantity", "has_price", "length", "round", "day")))


@query("""
, e AS (SELECT party, 'quantity_price' AS rule, c - quantity * uc AS d FROM items WHERE quantity > 0 AND uc > 0
  UNION ALL SELECT party, 'document_total', docs.c - s.e FROM docs JOIN (SELECT doc_id, sum(c) AS e FROM lines GROUP BY doc_id) s ON docs.doc_id = s.doc_id)
SELECT rule, party, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS benefits, CAST(sum(d) AS BIGINT) AS net, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) >= 3 AS systematic FROM e WHERE abs(d) > 10 GROUP BY rule, party""")
def math_error_summary(m):
    return rules.math_error_summary(m.items, m.documents).select(F.col("check").alias("rule"), "party", "n", _l("benefits"), _l("net"), "systematic")


@query(f""", {_UNBACKED_SQL.strip()}, {_ROUNDNESS_SQL.strip()},
zs AS (SELECT *, count(*) OVER w AS k, avg(c / 100.0::DOUBLE) OVER w AS mean, stddev_pop(c / 100.0::DOUBLE) OVER w AS std FROM items WINDOW w AS (PARTITION BY cost_code, doc_type, party)),
zz AS (SELECT item_id, abs((c / 100.0::DOUBLE - mean) / std) AS z FROM zs WHERE k >= 5 AND std > 0 AND std >= 0.01 * abs(mean)),
av AS (SELECT cost_code, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS mean FROM items WHERE c > 0 GROUP BY cost_code),
sd AS (SELECT item_id, least(1.0, CASE WHEN length(trim(description)) < 5 THEN 0.4 WHEN length(trim(description)) < 10 THEN 0.3 ELSE 0 END + CASE WHEN c > 10000000 AND length(trim(description)) < 15 THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM items),
f AS (SELECT 'amount_outlier' AS kind, item_id AS subject, least(0.95, 0.7 + 0.1 * (z - 2.5))::DOUBLE AS confidence FROM zz WHERE z > 2.5
  UNION ALL SELECT 'unusually_large', item_id, least(0.95, 0.7 + 0.05 * (c / 100.0::DOUBLE / mean - 3))::DOUBLE FROM items JOIN av ON items.cost_code = av.cost_code WHERE c > 10000000 AND c / 100.0::DOUBLE / mean > 3
  UNION ALL SELECT 'suspicious_description', item_id, (0.6 + 0.3 * score)::DOUBLE FROM sd WHERE score >= 0.7 UNION ALL SELECT 'round_amount', item_id, r FROM rr WHERE c >= 100000 AND r >= 0.7 UNION ALL SELECT 'missing_change_order', item_id, confidence FROM unbacked)
SELECT kind, subject, round(confidence, 6) AS confidence FROM f""")
def anomalies(m):
    return engine.anomalies(m.items, m.documents).select("kind", "subject", _r(F.col("confidence"), "confidence"))


@query(f""", {_PAIRS_SQL.strip()}
SELECT dst AS doc_id, kind AS relationship_type, 'outgoing' AS direction FROM rel WHERE src = 14 UNION ALL SELECT src, kind, 'incoming' FROM rel WHERE dst = 14""")
def related_documents(m):
    return lookups.related_documents(m.documents, relationships.pair_rules(m.documents), 14).select("doc_id", "relationship_type", "direction")


@query(f""", {_PAIRS_SQL.strip()}
SELECT src AS source_doc_id, dst AS target_doc_id, kind AS relationship_type FROM rel WHERE kind <> 'parent_child'""")
def new_relationships(m):
    found = relationships.pair_rules(m.documents)
    return relationships.new_relations(found, found.filter("relationship_type = 'parent_child'"), 0.0).select("source_doc_id", "target_doc_id", "relationship_type")


@query(f""", {_PAIRS_SQL.strip()}, e AS (SELECT DISTINCT src, dst FROM rel), one AS (SELECT dst AS id, 1 AS depth FROM e WHERE src = 14)
SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT * FROM one UNION ALL SELECT e.dst, 2 FROM one JOIN e ON e.src = one.id) WHERE id <> 14 GROUP BY id""")
def entity_neighbours(m):
    edges = graph.document_edges(relationships.pair_rules(m.documents))
    return graph.neighbours(edges, 14, 2).select("id", _l("depth"))


# --- extraction from texts -------------------------------------------------------------------------------------------------

_TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in extract.TYPE_WORDS) + " ELSE 'other' END"


@query(f"SELECT {_TYPE_SQL} AS doc_type, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL", model=False)
def text_types(m):
    return extract.metadata(m.table("documents")).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, 2::BIGINT AS n_amounts, least(quantity, c / 100.0::DOUBLE) AS low, greatest(quantity, c / 100.0::DOUBLE) AS high, c / 100.0::DOUBLE AS total FROM lines")
def text_amounts(m):
    """Items written as lines of text, and read back."""
    text = F.concat(F.col("description"), F.lit(" at $"), F.col("quantity").cast("string"), F.lit("; total amount due: "), amounts.format_currency(F.col("amount")))
    return extract.metadata(m.line_items.select("item_id", text.alias("text"))).select("item_id", _l("n_amounts"), "low", "high", "total")


@query(r"""
WITH a AS (SELECT doc_id, regexp_matches(lower(text), 'reject|denied|declin|disapprov|not approved') AS no, regexp_matches(regexp_replace(lower(text), 'disapprov|not approved', '', 'g'), 'approv|accepted') AS yes, regexp_matches(lower(text), 'pending|under review|submitted') AS waits FROM documents)
SELECT CASE WHEN no AND yes THEN 'contradictory' WHEN no THEN 'rejected' WHEN yes THEN 'approved' WHEN waits THEN 'pending' ELSE 'none' END AS approval, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""", model=False)
def text_approvals(m):
    return extract.metadata(m.table("documents")).groupBy("approval").agg(F.count(F.lit(1)).alias("n"))


# --- likeness, confidences and explanations --------------------------------------------------------------------------------

_LIKE_SQL = f"""
WITH RECURSIVE {SQL.strip()},
ds AS MATERIALIZED (SELECT cost_code, description, list_distinct(string_split(lower(description), ' ')) AS w FROM lines GROUP BY cost_code, description),
li AS MATERIALIZED (SELECT a.cost_code, a.description AS a, b.description AS b FROM ds a JOIN ds b ON a.cost_code = b.cost_code AND {_jaccard_sql('a.w', 'b.w')} >= 0.5),
rc(cost_code, a, b) AS (SELECT cost_code, a, b FROM li UNION SELECT rc.cost_code, rc.a, li.b FROM rc JOIN li ON rc.cost_code = li.cost_code AND rc.b = li.a),
groups AS MATERIALIZED (SELECT cost_code, a AS description, min(b) AS "like" FROM rc GROUP BY cost_code, a)"""


@query(f"""{_LIKE_SQL.strip()}
SELECT cost_code, description, "like" FROM groups""", model=False)
def similar_descriptions(m):
    return rules.description_groups(m.line_items, ("cost_code",), 0.5)


@query(f"""{_LIKE_SQL.strip()},
p AS (SELECT lines.cost_code || ': ' || "like" AS name, c / 100.0::DOUBLE / quantity AS price FROM lines JOIN groups ON lines.cost_code = groups.cost_code AND lines.description = groups.description WHERE quantity > 0)
SELECT name, CAST(count(*) AS BIGINT) AS n, round(min(price), 8) AS low, round(max(price), 8) AS high, round(stddev_pop(price) / avg(price), 4) AS cv FROM p GROUP BY name HAVING count(*) >= 2 AND stddev_pop(price) / avg(price) > 0.2""", model=False)
def price_variation_by_likeness(m):
    groups = rules.description_groups(m.line_items, ("cost_code",), 0.5)
    items = m.line_items.join(groups, ["cost_code", "description"]).withColumn("name", F.concat_ws(": ", "cost_code", "like"))
    return rules.similar_items_prices(items, column="name").select("name", "n", _r(F.col("low"), "low", 8), _r(F.col("high"), "high", 8), _r(F.col("cv"), "cv", 4))


@query("""
, t AS (SELECT c // 10000 AS k, description || CASE WHEN quantity % 7 = 0 THEN ' HVAC unit' ELSE '' END || CASE WHEN quantity % 5 = 0 THEN ' delivery' ELSE '' END AS d FROM lines),
g AS (SELECT k, count(*) AS n, sum(CASE WHEN contains(d, 'HVAC') THEN 1 ELSE 0 END) AS hvac, sum(CASE WHEN contains(d, 'delivery') THEN 1 ELSE 0 END) AS delivery FROM t GROUP BY k)
SELECT k * 100 AS amount, CAST(n AS BIGINT) AS n, CAST(hvac AS BIGINT) AS hvac, CAST(delivery AS BIGINT) AS delivery FROM g WHERE n >= 2 AND (hvac >= 2 OR (hvac > 0 AND delivery > 0))""")
def hvac_duplicates(m):
    """Some items are named as equipment and deliveries here, as the tables have no such."""
    named = F.concat("description", F.when(F.col("quantity") % 7 == 0, " HVAC unit").otherwise(""), F.when(F.col("quantity") % 5 == 0, " delivery").otherwise(""))
    return rules.hvac_duplicates(m.line_items.withColumn("description", named), agg.coarse(F.col("amount"))).select(F.col("key").alias("amount"), "n", "hvac", "delivery")


@query("""
, f AS (SELECT item_id, list_filter([CASE WHEN c > 10000000 THEN 'large amount' END, CASE WHEN length(description) < 5 THEN 'very short description' END, CASE WHEN c % 100000 = 0 AND c > 1000000 THEN 'round large amount' END, CASE WHEN day(date_created) >= 28 THEN 'end of month' END], lambda x: x IS NOT NULL) AS r FROM items)
SELECT item_id, CASE WHEN len(r) > 0 THEN array_to_string(r, '; ') ELSE 'features unusual together' END AS reasons FROM f""")
def explained_features(m):
    return rules.explained(rules.features(m.items)).select("item_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""
, s AS (SELECT project_id, doc_id, date_created, count(*) AS parts, sum(c) AS s FROM items WHERE c < 1500000 GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT s.project_id, s.doc_id, parts, s, i.item_id, i.c, i.description, row_number() OVER (PARTITION BY s.project_id, s.doc_id ORDER BY abs(i.c - s), i.item_id) AS k FROM s JOIN items i ON s.project_id = i.project_id AND date_diff('day', s.date_created, i.date_created) BETWEEN 1 AND 90 AND abs(i.c - s) * 1000 <= 100 * s),
a AS (SELECT j.doc_id, j.parts, j.s, j.item_id, j.c, sum(CASE WHEN {_jaccard_sql("string_split(j.description, ' ')", "string_split(p.description, ' ')")} >= 0.6 THEN 1 ELSE 0 END) AS alike FROM j JOIN items p ON p.doc_id = j.doc_id AND p.c < 1500000 WHERE k = 1 GROUP BY ALL)
SELECT doc_id, item_id AS later_id, CAST(alike AS BIGINT) AS alike, round(least(0.95, 0.7 + greatest(0, 0.15 * (1 - least(1, abs(c - s)::DOUBLE / s * 10))) + least(0.1, (parts - 1) * 0.02) + least(0.1, alike * 0.02))::DOUBLE, 6) AS confidence FROM a""")
def combination_confidence(m):
    found = sequences.combined_amounts(m.items, most=15_000)
    return sequences.combined_confidence(found, m.items, most=15_000).select("doc_id", "later_id", _l("alike"), _r(F.col("confidence"), "confidence"))


@query(f"""
, t AS (SELECT doc_id, list_distinct(flatten(list(list_intersect(string_split(description || CASE WHEN quantity % 2 = 0 THEN ' steel' ELSE '' END || CASE WHEN quantity % 3 = 0 THEN ' concrete roofing' ELSE '' END, ' '), ['steel', 'concrete', 'roofing'])))) AS t FROM items WHERE doc_type = 'change_order' GROUP BY doc_id),
d AS (SELECT project_id, docs.doc_id, t, lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM docs JOIN t ON docs.doc_id = t.doc_id WHERE doc_type = 'change_order' WINDOW w AS (PARTITION BY project_id ORDER BY date_created, docs.doc_id))
SELECT project_id, doc_id, array_to_string(list_sort(list_intersect(list_intersect(t, t2), t3)), ',') AS shared FROM d WHERE len(list_intersect(list_intersect(t, t2), t3)) >= 2""")
def interconnected_changes(m):
    """Some items are named with building terms here."""
    named = F.concat("description", F.when(F.col("quantity") % 2 == 0, " steel").otherwise(""), F.when(F.col("quantity") % 3 == 0, " concrete roofing").otherwise(""))
    return rules.interconnected_changes(m.documents, m.items.withColumn("description", named)).select("project_id", "doc_id", F.array_join("shared", ",").alias("shared"))


@query("""
, t AS (SELECT item_id, description || CASE WHEN quantity % 4 = 0 THEN ' extra fee' WHEN quantity % 4 = 1 THEN ' overheads' ELSE '' END AS d FROM lines WHERE c > 10000)
SELECT item_id, contains(d, 'extra') AS suspicious FROM t WHERE contains(d, ' fee') OR contains(d, ' overheads')""")
def hidden_fees(m):
    """Some items are named as fees here."""
    named = F.concat("description", F.when(F.col("quantity") % 4 == 0, " extra fee").when(F.col("quantity") % 4 == 1, " overheads").otherwise(""))
    return detectors.hidden_fees(m.line_items.withColumn("description", named)).select("item_id", "suspicious")


@query("""
, t AS (SELECT doc_id, item_id, c, description || CASE WHEN quantity % 9 = 0 THEN ' total' ELSE '' END AS d FROM lines), u AS (SELECT *, count(*) OVER w AS n, sum(c) OVER w - c AS rest FROM t WINDOW w AS (PARTITION BY doc_id))
SELECT item_id, c AS amount_cents, CAST(rest AS BIGINT) AS rest FROM u WHERE n > 5 AND contains(d, ' total') AND abs(c - rest) * 1000 > 10 * abs(rest)""")
def total_lines(m):
    """Some items are named as totals here."""
    named = F.concat("description", F.when(F.col("quantity") % 9 == 0, " total").otherwise(""))
    return agg.total_lines(m.line_items.withColumn("description", named)).select("item_id", _c("amount"), "rest")


@query("SELECT doc_id, c AS amount_cents, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, c // 100000 * 100000 AS c FROM lines) GROUP BY doc_id, c HAVING count(*) > 1")
def amount_groups(m):
    rows = m.line_items.withColumn("amount", agg.coarse(F.col("amount"), 1000).cast("decimal(15,2)"))
    return matching.amount_groups(rows).select("doc_id", _c("amount"), "n")


@query("""
, a AS (SELECT * FROM lines WHERE doc_id = 11), b AS (SELECT * FROM lines WHERE doc_id = 14),
s AS (SELECT a.item_id AS a_item_id, b.item_id AS b_item_id, 0.4 * greatest(0, 1 - abs(a.c - b.c)::DOUBLE / greatest(a.c, b.c) / 0.05) + 0.3 * CAST(len(list_intersect(string_split(a.description, ' '), string_split(b.description, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split(a.description, ' '), string_split(b.description, ' ')))) + 0.05 AS similarity FROM a, b)
SELECT a_item_id, b_item_id, round(similarity::DOUBLE, 6) AS similarity FROM s WHERE similarity >= 0.05""")
def context_matches_between_documents(m):
    return matching.context_matches_between_documents(m.line_items, 11, 14, 0.05).select("a_item_id", "b_item_id", _r(F.col("similarity"), "similarity"))


@query("SELECT item_id, array_to_string(list_sort(list_filter(string_split(description, ' '), lambda x: length(x) > 3)), ',') AS words FROM lines")
def item_keywords(m):
    from tallyforge.functions.texts import keywords

    return m.line_items.select("item_id", F.array_join(F.array_sort(keywords(F.col("description"))), ",").alias("words"))


# --- registered matches, flags, projects -----------------------------------------------------------------------------------


def _matches(m):
    p = matching.item_matches(m.items).filter("a_item_id < b_item_id")
    return p.select(F.col("a_item_id").alias("source_item_id"), F.col("b_item_id").alias("target_item_id"))


_MATCHES_SQL = "reg AS (SELECT a.item_id AS s, b.item_id AS t FROM items a JOIN items b ON a.project_id = b.project_id AND a.doc_id <> b.doc_id AND abs(a.c - b.c) * 1000 <= 10 * a.c WHERE a.c > 0 AND b.c > 0 AND a.item_id < b.item_id)"


@query(f""", {_MATCHES_SQL}, ids AS (SELECT item_id FROM lines WHERE quantity = 7)
SELECT s AS source_item_id, t AS target_item_id FROM reg WHERE s IN (SELECT item_id FROM ids) OR t IN (SELECT item_id FROM ids)""")
def registered_matches(m):
    return lookups.registered_matches(_matches(m), m.line_items.filter("quantity = 7"))


@query(f""", {_MATCHES_SQL}, f AS (SELECT a.item_id AS a, b.item_id AS b FROM lines a JOIN lines b ON a.quantity = 7 AND b.quantity = 8)
SELECT s AS source_item_id, t AS target_item_id FROM reg WHERE (s, t) IN (SELECT a, b FROM f) OR (t, s) IN (SELECT a, b FROM f)""")
def known_matches(m):
    found = matching.item_matches(m.items.filter("quantity IN (7, 8)")).select("a_item_id", "b_item_id")
    seven = m.line_items.filter("quantity = 7").select(F.col("item_id").alias("a_item_id")).distinct()
    eight = m.line_items.filter("quantity = 8").select(F.col("item_id").alias("b_item_id")).distinct()
    return lookups.known_matches(_matches(m), found.join(seven, "a_item_id", "left_semi").join(eight, "b_item_id", "left_semi"))


@query("SELECT item_id AS flag_id, round(quantity / 50.0::DOUBLE, 6) AS confidence FROM lines WHERE cost_code = 'Brand#12' AND quantity >= 40 AND item_status = 'pending'")
def flags_by_type(m):
    """Items as flags: their cost code as type, and a fiftieth of their quantity as confidence."""
    flags = m.line_items.select(F.col("item_id").alias("flag_id"), F.col("cost_code").alias("flag_type"), (F.col("quantity") / 50).alias("confidence"), F.col("item_status").alias("status"))
    return lookups.flags_by_type(flags, "Brand#12", 0.8, "pending").select("flag_id", _r(F.col("confidence"), "confidence"))


@query("SELECT project_id, CAST(count(*) AS BIGINT) AS rows FROM docs WHERE project_id <> 7 GROUP BY project_id")
def projects(m):
    from tallyforge.operators.registry import projects, without_project

    return projects(without_project(m.documents, 7))


@query("SELECT doc_id, party, 'changes' AS project_id FROM docs WHERE doc_type = 'change_order' AND c > 30000000 UNION ALL SELECT doc_id, party, 'invoices' FROM docs WHERE doc_type = 'invoice' AND c > 30000000")
def merged_results(m):
    from tallyforge.operators.registry import merged_results

    big = lambda kind: m.documents.filter((F.col("doc_type") == kind) & (F.col("total") > 300_000)).select("doc_id", "party")
    return merged_results({"invoices": big("invoice"), "changes": big("change_order")})


# --- reports as tables -----------------------------------------------------------------------------------------------------


@query(f""", {_PAIRS_SQL.strip()},
n AS (SELECT doc_id, count(*) AS n, sum(c) AS s FROM lines GROUP BY doc_id), r AS (SELECT d, count(*) AS k FROM (SELECT src AS d FROM rel UNION ALL SELECT dst FROM rel) GROUP BY d)
SELECT docs.doc_id, doc_type || ' of ' || party || ', ' || date_created || ': ' || coalesce(n, 0) || ' items, $' || format('{{:,.2f}}', coalesce(s, 0)::DOUBLE / 100) || ', ' || coalesce(k, 0) || ' relations' AS text FROM docs LEFT JOIN n ON docs.doc_id = n.doc_id LEFT JOIN r ON docs.doc_id = d""")
def document_reports(m):
    return reports.document_reports(m.documents, m.line_items, relationships.pair_rules(m.documents))


@query("""
, n AS (SELECT project_id, doc_type, count(*) AS n FROM docs GROUP BY ALL), t AS (SELECT project_id, string_agg(n || ' ' || doc_type, ', ' ORDER BY doc_type) AS t FROM n GROUP BY project_id)
SELECT docs.project_id, 'From ' || min(date_created) || ' to ' || max(date_created) || ' (' || date_diff('day', min(date_created), max(date_created)) || ' days), ' || count(*) || ' documents: ' || t AS text FROM docs JOIN t ON docs.project_id = t.project_id GROUP BY docs.project_id, t""")
def timeline_sentences(m):
    return reports.timeline_sentences(m.documents)


@query(f""", {_REAPPEARED_SQL.strip()}, {_UNBACKED_SQL.strip()},
d AS (SELECT item_id FROM reappeared UNION SELECT item_id FROM unbacked), a AS (SELECT DISTINCT ON (item_id) item_id, c FROM lines), t AS (SELECT count(*) AS n, sum(c) AS s FROM d JOIN a USING (item_id)),
p AS (SELECT item_status AS kind, count(*) AS n, max(quantity / 50.0::DOUBLE) AS high FROM lines GROUP BY item_status)
SELECT 'summary' AS section, 'Of ' || (SELECT count(*) FROM docs) || ' documents with ' || (SELECT count(*) FROM lines) || ' line items, $' || format('{{:,.2f}}', s::DOUBLE / 100) || ' is in dispute.' AS text FROM t
UNION ALL SELECT 'disputed amounts', n || ' disputed amounts come to $' || format('{{:,.2f}}', s::DOUBLE / 100) || '.' FROM t UNION ALL SELECT 'pattern: ' || kind, n || ' findings, confidence up to ' || format('{{:.2f}}', high) || '.' FROM p""")
def narrative(m):
    """Items by status stand for patterns here."""
    patterns = m.line_items.select(F.col("item_status").alias("kind"), (F.col("quantity") / 50).alias("confidence"))
    return reports.narrative(m.documents, m.line_items, engine.disputed_amounts(m.items, m.documents), patterns)


# --- vectors kept ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(min(len(embedding)) AS BIGINT) AS least, CAST(max(len(embedding)) AS BIGINT) AS most, 0::BIGINT AS zeros FROM embeddings WHERE vec_id % 3 <> 0", model=False)
def vector_stats(m):
    v = m.table("embeddings")
    s = search.vector_stats(search.removed_vectors(v, v.filter("vec_id % 3 = 0")))
    return s.select("vectors", _l("least_dimensions").alias("least"), _l("most_dimensions").alias("most"), _l("zeros"))


# --- texts written and read back -------------------------------------------------------------------------------------------


def _tables_text(m):
    """A text for each document: a header, and a line for each item."""
    money = lambda c: amounts.format_currency(F.col(c))
    line = F.concat_ws(" | ", "description", F.col("quantity").cast("string"), money("unit_price"), money("amount"))
    lines = m.line_items.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_number", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return lines.select("doc_id", F.concat(F.lit("Item | Qty | Rate | Amount\n"), "t", F.lit("\nGrand total | | | $1.00")).alias("text"))


@query("SELECT doc_id, description, CAST(quantity AS DOUBLE) AS quantity, c / 100.0::DOUBLE AS amount FROM lines")
def table_items(m):
    return extract.table_items(extract.table_rows(_tables_text(m))).select("doc_id", "description", "quantity", "amount")


@query("SELECT DISTINCT doc_id, 0::BIGINT AS description, 3::BIGINT AS amount, 1::BIGINT AS quantity, 2::BIGINT AS unit_price FROM lines")
def table_key_columns(m):
    return extract.key_columns(extract.table_rows(_tables_text(m))).select("doc_id", *map(_l, ("description", "amount", "quantity", "unit_price")))


@query("SELECT doc_id, description, c / 100.0::DOUBLE AS amount FROM lines")
def text_line_items(m):
    line = F.concat(F.col("item_number").cast("string"), F.lit(". "), "description", F.lit(": "), amounts.format_currency(F.col("amount")))
    texts = m.line_items.groupBy("doc_id").agg(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\nSubtotal: $3.00")).alias("text"))
    return extract.line_items(texts).select("doc_id", "description", "amount")


@query("SELECT doc_id, 'Job ' || project_id AS project_name, 'P-' || project_id AS project_number, 'Builder ' || party AS contractor, 'School District' AS owner, CAST(number AS VARCHAR) AS follows FROM docs")
def text_project_information(m):
    text = F.concat(F.lit("CHANGE ORDER\nPROJECT: Job "), F.col("project_id").cast("string"), F.lit("\nPROJECT NUMBER: P-"), F.col("project_id").cast("string"), F.lit("\nCONTRACTOR: Builder "), "party", F.lit("\nOWNER: School District\n\nThis follows Change Order #"), F.col("number").cast("string"), F.lit("."))
    return extract.project_information(m.documents.select("doc_id", text.alias("text"))).select("doc_id", "project_name", "project_number", "contractor", "owner", "follows")


@query("""
SELECT doc_id, 'change_order' AS kind, CAST(number AS VARCHAR) AS reference, CASE WHEN status = 'rejected' THEN 'rejected' WHEN status = 'approved' THEN 'approved' END AS status FROM docs
UNION ALL SELECT doc_id, 'invoice', 'INV-' || doc_id, NULL FROM docs""")
def text_references(m):
    said = F.when(F.col("status") == "rejected", "We rejected ").when(F.col("status") == "approved", "We approved ").otherwise("See ")
    text = F.concat(said, F.lit("Change Order #"), F.col("number").cast("string"), F.lit(". Then there is Invoice INV-"), F.col("doc_id").cast("string"), F.lit(" too."))
    return extract.references(m.documents.select("doc_id", text.alias("text"))).select("doc_id", "kind", "reference", "status")


@query("SELECT doc_id, CASE doc_type WHEN 'contract' THEN strftime(date_created, '%m/%d/%Y') ELSE CAST(doc_id AS VARCHAR) END AS first, CASE doc_type WHEN 'contract' THEN format('{:,.2f}', c / 100.0::DOUBLE) END AS sum FROM docs WHERE doc_type IN ('contract', 'invoice')")
def text_fields(m):
    d = m.documents.filter("doc_type IN ('contract', 'invoice')")
    contract = F.concat(F.lit("AGREEMENT\nContract Date: "), F.date_format("date_created", "MM/dd/yyyy"), F.lit("\nContract Sum: $"), F.format_number("total", 2))
    text = F.when(F.col("doc_type") == "contract", contract).otherwise(F.concat(F.lit("INVOICE\nInvoice No: "), F.col("doc_id").cast("string")))
    f = extract.fields(d.select("doc_id", text.alias("text")))
    return f.select("doc_id", F.coalesce(F.col("fields")["contract_date"], F.col("fields")["invoice_number"]).alias("first"), F.col("fields")["contract_sum"].alias("sum"))


@query("""
SELECT doc_id, c * 10 % 1000 = 0 AS retainage_ok, number % 2 = 0 AS due_ok FROM (SELECT *, c % 100000 AS x FROM docs)""")
def text_financial_checks(m):
    """Payment figures written into texts: the retainage is cut to whole tens of cents, the payment due is right for even numbers."""
    c, rest = cents(F.col("total")), F.floor(cents(F.col("total")) / 100) * 10
    money = lambda x: amounts.format_currency(x / 100)
    text = F.concat(F.lit("Completed to date: "), money(c), F.lit("\nRetainage (10%): "), money(rest + F.when(c % 100 == 0, 0).otherwise(100)), F.lit("\nCurrent payment due: "), money(c - rest - F.when(c % 100 == 0, 0).otherwise(100) + F.when(F.col("number") % 2 == 0, 0).otherwise(500)), F.lit("\nPrevious certificates: $0.00"))
    return extract.financial_checks(m.documents.select("doc_id", text.alias("text"))).select("doc_id", "retainage_ok", "due_ok")


@query("""
SELECT doc_id, CASE WHEN number % 3 = 0 THEN 1 ELSE 0 END::BIGINT + CASE WHEN number % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS failed FROM docs WHERE number % 3 = 0 OR number % 2 = 0""")
def stated_figures(m):
    """Documents with stated figures in JSON; those of every third number have a wrong line, those of even numbers a wrong sum."""
    n = F.col("number")
    meta = F.to_json(F.struct(F.array(F.struct(F.lit(2.0).alias("quantity"), n.cast("double").alias("unit_price"), (2 * n + F.when(n % 3 == 0, 1).otherwise(0)).cast("double").alias("total"))).alias("line_items"), F.lit(100.0).alias("original_contract"), n.cast("double").alias("change_orders"), (100 + n + F.when(n % 2 == 0, 5).otherwise(0)).cast("double").alias("adjusted_contract")))
    return detectors.metadata_math(m.documents.select("doc_id", meta.alias("meta_data"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("failed"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM r GROUP BY user_id, k""", model=False)
def event_sessions(m):
    from tallyforge.streaming.ingest import sessions

    return sessions(m.table("events")).select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query(f""", {_EDGES_SQL}, p1 AS (SELECT [src, dst] AS p, dst AS t FROM e WHERE src = 1), p2 AS (SELECT list_append(p, dst) AS p, dst AS t FROM p1 JOIN e ON t = src WHERE NOT list_contains(p, dst)), p3 AS (SELECT list_append(p, dst) AS p, dst AS t FROM p2 JOIN e ON t = src WHERE NOT list_contains(p, dst))
SELECT array_to_string(p, '>') AS path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE t = (SELECT max(dst) FROM e WHERE src = 1)""")
def document_paths(m):
    edges = _edges(m)
    to = edges.filter("src = 1").agg(F.max("dst")).first()[0]
    return graph.paths(edges, 1, to).select(F.array_join("path", ">").alias("path"))


# --- registering, networks and journeys ------------------------------------------------------------------------------------


@query("""
, h AS (SELECT * FROM docs WHERE doc_id % 5 < 3), f AS (SELECT * FROM docs WHERE doc_id % 5 >= 2)
SELECT 'documents' AS "table", CAST(count(*) AS BIGINT) AS rows FROM docs UNION ALL SELECT 'pages', (SELECT count(*) FROM lines WHERE doc_id % 5 < 3) + (SELECT count(DISTINCT (doc_id, item_number)) FROM lines WHERE doc_id % 5 > 2)
UNION ALL SELECT 'line_items', count(*) FROM lines UNION ALL SELECT 'annotations', count(*) FROM lines UNION ALL SELECT 'reports', count(*) FROM (SELECT 1 FROM h UNION ALL SELECT 1 FROM f) UNION ALL SELECT 'report_evidence', count(*) FROM lines UNION ALL SELECT 'financial_transactions', count(*) FROM lines
UNION ALL SELECT 'change_orders', count(*) FROM docs WHERE doc_type = 'change_order' UNION ALL SELECT 'payment_applications', count(*) FROM docs WHERE doc_type = 'payment_app'
UNION ALL SELECT 'analysis_flags', (SELECT count(*) FROM lines WHERE doc_id % 5 < 3) + (SELECT count(DISTINCT (item_id, item_status)) FROM lines WHERE doc_id % 5 > 2) UNION ALL SELECT 'amount_matches', (SELECT count(*) FROM lines WHERE doc_id % 5 < 3) + (SELECT count(DISTINCT (item_id, doc_id)) FROM lines WHERE doc_id % 5 > 2) UNION ALL SELECT 'document_relationships', count(DISTINCT (project_id, doc_id)) FROM docs""")
def registered_tables(m):
    """Rows of each of the model's tables after fresh rows, some of them known, are registered."""
    d, i = m.documents, m.line_items
    text = lambda c: F.col(c).cast("string")
    parts = {
        "documents": d.select(text("doc_id").alias("doc_id"), text("doc_id").alias("file_hash"), "file_name", F.col("doc_id").alias("_k")),
        "pages": i.select(text("doc_id").alias("doc_id"), F.col("item_number").cast("int").alias("page_number"), F.col("doc_id").alias("_k")),
        "change_orders": d.filter("doc_type = 'change_order'").select(text("doc_id").alias("doc_id"), F.col("total").alias("amount"), F.col("doc_id").alias("_k")),
        "payment_applications": d.filter("doc_type = 'payment_app'").select(text("doc_id").alias("doc_id"), F.col("total").alias("amount_requested"), F.col("doc_id").alias("_k")),
        "analysis_flags": i.select("item_id", F.col("item_status").alias("flag_type"), F.col("doc_id").alias("_k")),
        "amount_matches": i.select(F.col("item_id").alias("source_item_id"), text("doc_id").alias("target_item_id"), F.col("doc_id").alias("_k")),
        "document_relationships": d.select(text("project_id").alias("source_doc_id"), text("doc_id").alias("target_doc_id"), F.lit("parent_child").alias("relationship_type"), F.col("doc_id").alias("_k")),
        "reports": d.select(F.col("doc_id").alias("report_id"), F.col("doc_id").alias("_k")),
    }
    keyless = {"line_items": i.select("item_id", text("doc_id").alias("doc_id")), "annotations": i.select(text("doc_id").alias("doc_id"), F.col("description").alias("content")), "report_evidence": i.select("item_id", text("doc_id").alias("doc_id")), "financial_transactions": i.select("item_id", "amount")}
    out = [(name, upserts.registered(name, df.filter("_k % 5 < 3").drop("_k"), df.filter("_k % 5 >= 2").drop("_k"))) for name, df in parts.items()]
    out += [(name, upserts.registered(name, df.filter("false"), df)) for name, df in keyless.items()]
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in out]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every


@query("SELECT docs.doc_id, docs.party, string_agg(item_number || ' ' || description, '; ' ORDER BY item_number, item_id) AS items FROM docs LEFT JOIN lines ON docs.doc_id = lines.doc_id WHERE docs.doc_id = 14 GROUP BY docs.doc_id, docs.party")
def document_by_id(m):
    d = lookups.document_by_id(m.documents, m.line_items, 14)
    return d.select("doc_id", "party", F.array_join(F.transform("items", lambda x: F.concat_ws(" ", x["item_number"].cast("string"), x["description"])), "; ").alias("items"))


@query("""
, p AS (SELECT doc_id, string_agg(description, chr(10) || chr(10) ORDER BY item_number, description) AS t FROM lines WHERE doc_id % 2 = 0 GROUP BY doc_id), i AS (SELECT doc_id, string_agg(description, ' ' ORDER BY item_number, description) AS t FROM lines GROUP BY doc_id)
SELECT docs.doc_id, md5(coalesce(p.t, concat_ws(' ', doc_type, party, file_name, i.t))) AS text_md5 FROM docs LEFT JOIN p ON docs.doc_id = p.doc_id LEFT JOIN i ON docs.doc_id = i.doc_id""")
def document_content(m):
    """Items of even documents stand for their pages here."""
    pages = m.line_items.filter("doc_id % 2 = 0").select("doc_id", F.col("item_number").alias("page_number"), F.col("description").alias("content"))
    return lookups.document_content(m.documents, pages, m.line_items).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f""", {_PAIRS_SQL.strip()}, r AS (SELECT src, dst, CASE kind WHEN 'revision' THEN 0.85 ELSE 0.75 END AS w FROM rel WHERE kind IN ('parent_child', 'revision')),
i AS (SELECT dst AS id, src AS previous_id FROM r JOIN docs ON doc_id = src QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w DESC, date_created DESC, src) = 1), o AS (SELECT src AS id, dst AS next_id FROM r JOIN docs ON doc_id = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, date_created, dst) = 1)
SELECT doc_id, previous_id, next_id FROM docs LEFT JOIN i ON doc_id = i.id LEFT JOIN o ON doc_id = o.id""")
def next_and_previous(m):
    return lookups.next_and_previous(m.documents, relationships.pair_rules(m.documents))


@query(f""", {_MATCHES_SQL}, one AS (SELECT DISTINCT ON (item_id) item_id, doc_id, description, c FROM lines)
SELECT s AS source_item_id, t AS target_item_id, a.doc_id AS source_doc_id, b.doc_id AS target_doc_id, a.c - b.c AS off_cents FROM reg JOIN one a ON a.item_id = s JOIN one b ON b.item_id = t""")
def match_details(m):
    d = lookups.match_details(_matches(m), m.line_items)
    return d.select("source_item_id", "target_item_id", "source_doc_id", "target_doc_id", (cents(F.col("source_amount")) - cents(F.col("target_amount"))).alias("off_cents"))


@query("""
SELECT project_id, CAST(min(date_created) AS VARCHAR) AS first, CAST(date_diff('day', min(date_created), max(date_created)) AS BIGINT) AS days, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS items, string_agg(DISTINCT doc_type, ', ' ORDER BY doc_type) AS doc_types, string_agg(DISTINCT party, ', ' ORDER BY party) AS partys FROM items GROUP BY project_id""")
def financial_journey(m):
    return lookups.financial_journey(m.items).select("project_id", _d("first"), _l("days"), "documents", "items", "doc_types", "partys")


@query("""
, o AS (SELECT * FROM lines ORDER BY item_id LIMIT 1), s AS (SELECT l.item_id, 0.4 * greatest(0, 1 - abs(l.c - o.c)::DOUBLE / greatest(l.c, o.c) / 0.05) + 0.3 * CAST(len(list_intersect(string_split(l.description, ' '), string_split(o.description, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split(l.description, ' '), string_split(o.description, ' ')))) + 0.05 AS similarity FROM lines l, o WHERE l.item_id <> o.item_id AND abs(l.c - o.c) * 1000 <= 50 * o.c)
SELECT item_id, round(similarity::DOUBLE, 6) AS similarity FROM s WHERE similarity >= 0.3""")
def context_matches_for_item(m):
    item = m.line_items.agg(F.min("item_id")).first()[0]
    return matching.context_matches_for_item(m.line_items, item, 0.3).select("item_id", _r(F.col("similarity"), "similarity"))


@query("""
, n AS (SELECT * FROM items WHERE abs(c - 5000000) * 1000 <= 10 * 5000000),
r AS (SELECT *, CASE WHEN lag(doc_type) OVER w = doc_type THEN 0 ELSE 1 END AS a, CASE WHEN lag(party) OVER w = party THEN 0 ELSE 1 END AS b FROM n WINDOW w AS (ORDER BY date_created, item_id)),
q AS (SELECT *, sum(a) OVER w AS ra, sum(b) OVER w AS rb FROM r WINDOW w AS (ORDER BY date_created, item_id ROWS UNBOUNDED PRECEDING))
SELECT 'doc_type' AS "column", CAST(ra AS BIGINT) AS run, min(doc_type) AS value, CAST(count(*) AS BIGINT) AS length FROM q GROUP BY ra UNION ALL SELECT 'party', CAST(rb AS BIGINT), min(party), count(*) FROM q GROUP BY rb""")
def amount_chronology(m):
    return matching.amount_chronology(m.items, 50_000.0).select("column", _l("run"), "value", "length")


def _progression_sql(sign, first, last):
    return f"""SELECT project_id, CAST(count(*) AS BIGINT) AS n, round(least(0.95, 0.7 + least(count(*) / 10.0::DOUBLE, 0.1) + least(CASE WHEN {first}(c) > 0 THEN abs({last}(c) - {first}(c))::DOUBLE / {first}(c) ELSE 0 END, 0.15))::DOUBLE, 6) AS confidence
FROM (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY date_created, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN c {sign} lag(c) OVER (PARTITION BY project_id ORDER BY date_created, doc_id) THEN 0 ELSE 1 END AS new FROM docs)) GROUP BY project_id, run HAVING count(*) >= 3"""


@query(_progression_sql("<=", "max", "min"))
def falling_progressions(m):
    p = sequences.progressions(m.documents, ("project_id",), "total", "date_created", "doc_id", False)
    return p.select("project_id", "n", _r(F.col("confidence"), "confidence"))


@query(f"""
, up AS ({_progression_sql(">=", "min", "max")}), down AS ({_progression_sql("<=", "max", "min")}),
d AS (SELECT project_id, sign(c - lag(c) OVER w) * sign(lead(c) OVER w - c) AS t FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id)),
g AS (SELECT project_id, day(date_created) AS day, count(*) AS n FROM docs GROUP BY ALL)
SELECT project_id, 'rising' AS pattern, n FROM up UNION ALL SELECT project_id, 'falling', n FROM down UNION ALL SELECT project_id, 'alternating', count(*) FROM d GROUP BY project_id HAVING count(*) >= 4 AND sum(CASE WHEN t < 0 THEN 1 ELSE 0 END) >= 0.75 * (count(*) - 2)
UNION ALL SELECT project_id, 'day of month', n FROM (SELECT project_id, n, sum(n) OVER (PARTITION BY project_id) AS s FROM g) WHERE n >= 3 AND n >= 0.3 * s""")
def sequence_patterns(m):
    return sequences.sequence_patterns(m.documents)


@query("""
, d AS (SELECT *, lag(date_created) OVER w AS pd, lag(doc_type) OVER w AS pt, lag(doc_id) OVER w AS pid, lead(doc_id) OVER w AS nid FROM docs WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id))
SELECT project_id, doc_id, 'first' AS event FROM d WHERE pid IS NULL UNION ALL SELECT project_id, doc_id, 'last' FROM d WHERE nid IS NULL UNION ALL SELECT project_id, doc_id, 'gap' FROM d WHERE date_diff('day', pd, date_created) > 30
UNION ALL SELECT project_id, doc_id, 'type change' FROM d WHERE pt <> doc_type UNION ALL SELECT project_id, doc_id, 'main' FROM docs WHERE c > 40000000""")
def key_documents(m):
    return sequences.key_documents(m.documents, F.col("total") > 400_000).select("project_id", "doc_id", "event")


@query(f""", {_MATCHES_SQL}, u AS (SELECT item_id FROM lines)
SELECT CAST((SELECT count(DISTINCT item_id) FROM lines) AS BIGINT) AS vertices, CAST((SELECT count(*) FROM reg) AS BIGINT) AS edges""")
def item_network(m):
    v, e = graph.item_network(m.line_items, _matches(m).withColumn("confidence", F.lit(1.0)))
    return v.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))


@query(f""", {_EDGES_SQL}{_distance_sql()}{_eigen_sql().replace(", v AS", ", ve AS").replace("FROM v)", "FROM ve)")},
dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), cl AS (SELECT s, count(*)::DOUBLE / sum(d) AS closeness FROM dist GROUP BY s),
bt AS (SELECT a.t, sum(a.paths * b.paths / c.paths) AS betweenness FROM dist a JOIN dist b ON a.t = b.s AND a.s <> b.t JOIN dist c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY a.t)
SELECT dg.id, CAST(degree AS BIGINT) AS degree, round(coalesce(closeness, 0), 6) AS closeness, round(coalesce(betweenness, 0), 6) AS betweenness, round(score, 9) AS eigenvector FROM dg LEFT JOIN cl ON dg.id = s LEFT JOIN bt ON dg.id = t LEFT JOIN x10 ON dg.id = x10.id""")
def centralities(m):
    return graph.centrality(_edges(m), rounds=10).select("id", "degree", _r(F.col("closeness"), "closeness"), _r(F.col("betweenness"), "betweenness"), _r(F.col("eigenvector"), "eigenvector", 9))


def _community_sql():
    out = ", b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e), l0 AS (SELECT DISTINCT src AS id, src AS c FROM b)"
    for k in range(1, 6):
        out += f", l{k} AS MATERIALIZED (SELECT src AS id, c FROM (SELECT src, c, count(*) AS n FROM b JOIN l{k - 1} ON dst = id GROUP BY src, c) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, c) = 1)"
    return out


@query(f""", {_EDGES_SQL}{_community_sql()}
SELECT id, c AS community FROM l5""")
def communities(m):
    return graph.communities(_edges(m))


@query(f""", {_EDGES_SQL}{_rank_sql()},
mu AS (SELECT count(*) AS mutual FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst), cy AS (SELECT count(*) AS cycles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst),
t AS (SELECT id FROM r10 ORDER BY round(rank, 12) DESC, id LIMIT 3)
SELECT CAST((SELECT count(DISTINCT src) FROM e) AS BIGINT) AS referring, CAST(mutual AS BIGINT) AS mutual, CAST(cycles AS BIGINT) AS cycles, (SELECT string_agg(id, ',' ORDER BY id) FROM t) AS central, round(CASE WHEN cycles > 0 THEN least(0.95, 0.7 + 0.05 * cycles) WHEN mutual > 0 THEN least(0.85, 0.6 + 0.05 * mutual) ELSE 0 END::DOUBLE, 6) AS confidence FROM mu, cy""")
def coordination(m):
    return detectors.coordination(relationships.pair_rules(m.documents), rounds=10, part="project_id").select("referring", "mutual", "cycles", F.array_join("central", ",").alias("central"), _r(F.col("confidence"), "confidence"))


@query(f""", {_PAIRS_SQL.strip()}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM rel), rj AS (SELECT DISTINCT src FROM rel WHERE kind = 'rejection'),
n AS (SELECT doc_id AS a, lead(doc_id) OVER w AS b, lead(doc_id, 2) OVER w AS c FROM docs WHERE doc_type = 'change_order' WINDOW w AS (PARTITION BY project_id ORDER BY number)),
c AS (SELECT [a.src, a.dst] AS p FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, a.dst, b.dst] FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT 'sequential_change_orders' AS kind, concat_ws('>', a, b, c) AS subject, 0.7::DOUBLE AS confidence FROM n WHERE c IS NOT NULL UNION ALL SELECT 'circular_reference', array_to_string(p, '>'), 0.9 FROM c
UNION ALL SELECT DISTINCT 'rejected_scope', a.item_id, 0.85 FROM items a JOIN rj ON a.doc_id = rj.src JOIN items b ON a.project_id = b.project_id AND a.doc_id <> b.doc_id AND abs(a.c - b.c) * 1000 <= 10 * a.c""")
def network_patterns(m):
    return detectors.network_patterns(m.documents, m.items, relationships.pair_rules(m.documents)).select("kind", "subject", _r(F.col("confidence"), "confidence"))


@query(f""", {_PAIRS_SQL.strip()}
SELECT src AS source_doc_id, dst AS target_doc_id, kind AS relationship_type FROM rel JOIN docs a ON a.doc_id = src JOIN docs b ON b.doc_id = dst WHERE a.party = 'BUILDING' OR b.party = 'BUILDING'""")
def relations_of_documents(m):
    some = m.documents.filter("party = 'BUILDING'")
    return reports.document_relations(some, relationships.pair_rules(m.documents)).select("source_doc_id", "target_doc_id", "relationship_type")


@query("""
, f AS (SELECT * FROM lines WHERE quantity >= 49)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, NULL::VARCHAR AS item_id, CAST(max(quantity) AS DOUBLE) AS score FROM f GROUP BY doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR), item_id, CAST(quantity AS DOUBLE) FROM f""")
def stored_evidence(m):
    found = reports.evidence(engine.finding(m.line_items.filter("quantity >= 49"), "large_quantity", "item_id", "quantity"), m.line_items)
    return reports.stored_evidence(1, found).select("doc_id", "item_id", F.col("relevance_score").cast("double").alias("score"))


@query("SELECT doc_id, strftime(date_created, '%m/%d/%Y') AS document_date, CASE WHEN doc_id % 2 = 0 THEN strftime(date_received, '%m/%d/%Y') END AS response_date FROM docs")
def text_dates(m):
    day = lambda c: F.date_format(c, "MM/dd/yyyy")
    text = F.concat(F.lit("INVOICE\nDATE: "), day("date_created"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nResponded: "), day("date_received"))).otherwise(""))
    return extract.dates(m.documents.select("doc_id", text.alias("text"))).select("doc_id", "document_date", "response_date")


@query("SELECT doc_id, 'Pour ' || number || ' slabs.' AS scope, CASE WHEN number % 2 = 0 THEN 'Steel was used instead of wood.' ELSE '' END AS substitutions, CASE WHEN number % 3 = 0 THEN 'Extra work is under Change Order 4.' WHEN number % 3 = 1 THEN 'Some extra hours.' ELSE '' END AS extra_work, number % 3 = 0 AS has_order FROM docs")
def text_scopes(m):
    n = F.col("number")
    text = F.concat(F.lit("SCOPE OF WORK: Pour "), n.cast("string"), F.lit(" slabs.\n\n"), F.when(n % 2 == 0, "Steel was used instead of wood.").otherwise("Nothing is new here."), F.lit("\n"), F.when(n % 3 == 0, "Extra work is under Change Order 4.").when(n % 3 == 1, "Some extra hours.").otherwise("All well."))
    s = extract.scope(m.documents.select("doc_id", text.alias("text")))
    return s.select("doc_id", "scope", F.array_join("substitutions", " ").alias("substitutions"), F.array_join("extra_work", " ").alias("extra_work"), F.col("extra_work_has_order").alias("has_order"))


# --- structure and outliers ------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {SQL.strip()}, {_EDGES_SQL},
reach(a, b) AS (SELECT src, dst FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS root FROM v LEFT JOIN (SELECT f.a, f.b FROM reach f JOIN reach g ON f.a = g.b AND f.b = g.a) x ON x.a = v.id GROUP BY v.id)
SELECT id, root, CAST(count(*) OVER (PARTITION BY root) AS BIGINT) AS size FROM r""", model=False)
def strong_components(m):
    return structure.strong_components(_edges(m)).select("id", "root", _l("size"))


@query(None)
def modularity_communities(m):
    """No SQL has the moves of Louvain's method; tests compare its modularity with a plain run's."""
    return structure.modularity_communities(_edges(m))


def _payment_points(m: Model) -> DataFrame:
    """Payment documents as points: thousands of the total, and four times the day of the month."""
    p = m.documents.filter("doc_type = 'payment_app'")
    return p.select(F.col("doc_id").alias("id"), F.floor(_c("total") / 100_000).alias("thousands"), (F.dayofmonth("date_created") * 4).alias("days"))


_POINTS_SQL = """
, pt AS MATERIALIZED (SELECT doc_id AS id, CAST(c // 100000 AS DOUBLE) AS x, CAST(day(date_created) * 4 AS DOUBLE) AS y FROM docs WHERE doc_type = 'payment_app')"""


@query(f"""{_POINTS_SQL},
pr AS MATERIALIZED (SELECT p.id, q.id AS other, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM pt p JOIN pt q ON p.id <> q.id),
kd AS MATERIALIZED (SELECT id, max(d) AS kd FROM (SELECT id, d FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) <= 10) GROUP BY id),
nb AS MATERIALIZED (SELECT pr.id, pr.other, d, kd FROM pr JOIN kd ON pr.id = kd.id AND d <= kd),
ds AS MATERIALIZED (SELECT nb.id, 1 / (avg(greatest(nb.d, o.kd)) + 1e-10) AS density FROM nb JOIN kd o ON o.id = nb.other GROUP BY nb.id)
SELECT ds.id, round(kd.kd, 6) AS k_distance, round(ds.density, 6) AS density, round(avg(o.density) / ds.density, 6) AS factor FROM nb JOIN ds ON ds.id = nb.id JOIN ds o ON o.id = nb.other JOIN kd ON kd.id = ds.id GROUP BY ds.id, ds.density, kd.kd""")
def local_outlier_factor(m):
    found = outliers.local_outlier_factor(_payment_points(m), ["thousands", "days"], 10)
    return found.select("id", *(_r(F.col(c), c) for c in ("k_distance", "density", "factor")))


@query(f"""
WITH RECURSIVE {SQL.strip()}{_POINTS_SQL},
nr AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM pt p JOIN pt q ON sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 5),
co AS MATERIALIZED (SELECT a AS id FROM nr GROUP BY a HAVING count(*) >= 6),
ln AS MATERIALIZED (SELECT a, b FROM nr WHERE a IN (SELECT id FROM co) AND b IN (SELECT id FROM co)),
reach(a, b) AS (SELECT a, a FROM ln UNION SELECT reach.a, ln.b FROM reach JOIN ln ON reach.b = ln.a),
cl AS MATERIALIZED (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a),
bo AS (SELECT nr.a AS id, min(cluster) AS cluster FROM nr JOIN cl ON nr.b = cl.id WHERE nr.a NOT IN (SELECT id FROM co) GROUP BY nr.a)
SELECT pt.id, coalesce(cl.cluster, bo.cluster) AS cluster, cl.id IS NOT NULL AS core FROM pt LEFT JOIN cl ON cl.id = pt.id LEFT JOIN bo ON bo.id = pt.id""", model=False)
def density_clusters(m):
    return outliers.density_clusters(_payment_points(m), ["thousands", "days"], 5.0, 6)


def _trees_sql(trees: int, sample: int, levels: int) -> str:
    """Isolation trees level by level: sampled points of each node, the node's feature and cut, and every point's way down."""

    def u(*parts: str) -> str:
        return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8))::BIGINT / 4294967296::DOUBLE)"

    mean = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"
    out = f"""{_POINTS_SQL}, sm0 AS MATERIALIZED (SELECT tree, x, y, 1::BIGINT AS node FROM (SELECT id, x, y, t AS tree FROM pt, range({trees}) r(t)) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {u("'42'", "tree", "id")}, id) <= {sample}),
at0 AS (SELECT id, x, y, t AS tree, 1::BIGINT AS node, 0.0::DOUBLE AS path, false AS done FROM pt, range({trees}) r(t))"""
    for k in range(levels + 1):
        many = "0" if k == levels else "CASE WHEN n > 1 THEN (hx > lx)::INT + (hy > ly)::INT ELSE 0 END"
        out += f""", g{k} AS (SELECT tree, node, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM sm{k} GROUP BY tree, node),
f{k} AS (SELECT *, CASE {many} WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN hx > lx THEN 0 ELSE 1 END ELSE CAST(floor({u("'42'", "'feature'", "tree", "node")} * 2) AS INT) END AS f FROM g{k}),
n{k} AS MATERIALIZED (SELECT tree, node, n, f, CASE f WHEN 0 THEN hx - {u("'42'", "'cut'", "tree", "node")} * (hx - lx) WHEN 1 THEN hy - {u("'42'", "'cut'", "tree", "node")} * (hy - ly) END AS cut FROM f{k}),
sm{k + 1} AS MATERIALIZED (SELECT s.tree, x, y, 2 * s.node + ((CASE f WHEN 0 THEN x ELSE y END) >= cut)::BIGINT AS node FROM sm{k} s JOIN n{k} n ON s.tree = n.tree AND s.node = n.node AND f IS NOT NULL),
at{k + 1} AS MATERIALIZED (SELECT id, x, y, a.tree, CASE WHEN done OR f IS NULL THEN a.node ELSE 2 * a.node + ((CASE f WHEN 0 THEN x ELSE y END) >= cut)::BIGINT END AS node, CASE WHEN done THEN path WHEN f IS NULL THEN path + {mean("n")} ELSE path + 1 END AS path, done OR f IS NULL AS done FROM at{k} a LEFT JOIN n{k} n ON a.tree = n.tree AND a.node = n.node)"""
    return out + f""", w AS (SELECT max(n) AS n FROM n0)
SELECT id, round(avg(path), 6) AS path, round(pow(2.0::DOUBLE, -avg(path) / (SELECT {mean("n")} FROM w)), 6) AS score FROM at{levels + 1} GROUP BY id"""


@query(_trees_sql(20, 64, 6))
def isolation_scores(m):
    points = _payment_points(m)
    nodes = outliers.isolation_trees(points, ["thousands", "days"], trees=20, sample=64)
    return outliers.isolation_scores(points, ["thousands", "days"], nodes, sample=64).select("id", _r(F.col("path"), "path"), _r(F.col("score"), "score"))


@query(f"""
WITH RECURSIVE {SQL.strip()},
cand AS MATERIALIZED (SELECT b.project_id, b.item_id AS big, b.c AS whole, s.item_id, s.c, row_number() OVER (PARTITION BY b.project_id, b.item_id, b.c ORDER BY s.c DESC, s.item_id DESC) AS k FROM items b JOIN items s ON b.project_id = s.project_id AND b.c > 5000000 AND s.c > 0 AND s.c < b.c AND date_diff('day', b.date_created, s.date_created) BETWEEN 1 AND 90),
f(project_id, big, whole, start, k, t, n) AS (SELECT project_id, big, whole, k, k, c, 1::BIGINT FROM cand
  UNION ALL SELECT f.project_id, f.big, f.whole, start, cand.k, CASE WHEN (t + c) * 10 <= f.whole * 11 THEN t + c ELSE t END, CASE WHEN (t + c) * 10 <= f.whole * 11 THEN n + 1 ELSE n END FROM f JOIN cand ON f.project_id = cand.project_id AND f.big = cand.big AND f.whole = cand.whole AND cand.k = f.k + 1),
l AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY project_id, big, whole)),
b AS (SELECT * FROM l WHERE abs(t - whole) * 10 <= whole QUALIFY row_number() OVER (PARTITION BY project_id, big, whole ORDER BY abs(t - whole), start) = 1)
SELECT project_id, big AS item_id, CAST(whole AS BIGINT) AS whole_cents, CAST(t AS BIGINT) AS sum_cents, n FROM b WHERE n >= 2""", model=False)
def best_splits(m):
    return splits.best_splits(m.items, least=50_000).select("project_id", F.col("big_id").alias("item_id"), F.col("whole").alias("whole_cents"), F.col("sum").alias("sum_cents"), "n")


def _applications(m: Model) -> DataFrame:
    """Payment applications with figures in meta_data as a document states them: of some documents the certificates or the payment are off."""
    a = m.payment_applications
    money = lambda c: c.cast("double").cast("string")
    before = F.col("earned") - F.col("requested")
    stated = F.struct(
        money(before * F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)).alias("previous_certificates"), money(F.col("earned")).alias("total_earned_less_retainage"),
        money(F.col("requested") + F.when(F.col("doc_id") % 7 == 0, 1000).otherwise(0)).alias("current_payment_due"),
    )
    return a.select("project_id", "doc_id", "number", F.to_json(stated).alias("meta_data"))


@query("""
, p AS (SELECT project_id, doc_id, number, c / 100.0::DOUBLE AS c, sum(c) OVER (PARTITION BY project_id ORDER BY number) / 100.0::DOUBLE AS earned FROM docs WHERE doc_type = 'payment_app'),
a AS (SELECT *, (earned - c) * CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS previous, c + CASE WHEN doc_id % 7 = 0 THEN 1000 ELSE 0 END AS due, lag(earned) OVER (PARTITION BY project_id ORDER BY number) AS earned_before FROM p),
x AS (SELECT project_id, doc_id, 'previous_certificate_mismatch' AS kind, previous AS stated, earned_before AS expected, 0.80::DOUBLE AS base FROM a WHERE earned_before IS NOT NULL UNION ALL SELECT project_id, doc_id, 'payment_calculation_error', due, earned - previous, 0.85 FROM a WHERE earned_before IS NOT NULL)
SELECT project_id, doc_id, kind, round(stated, 2) AS stated, round(expected, 2) AS expected, round(least(0.95, base + abs(stated - expected) / greatest(stated, expected)), 6) AS confidence FROM x WHERE abs(stated - expected) > 0.01 AND abs(stated - expected) / greatest(stated, expected) > 0.001""")
def certificate_mismatches(m):
    found = splits.certificate_mismatches(_applications(m))
    return found.select("project_id", "doc_id", "kind", _r(F.col("stated"), "stated", 2), _r(F.col("expected"), "expected", 2), _r(F.col("confidence"), "confidence"))


@query("""
, p AS (SELECT project_id, doc_id, number, item_number, item_id, quantity / 50.0::DOUBLE AS share FROM items WHERE doc_type = 'payment_app'),
j AS (SELECT p.project_id, p.item_number, p.item_id, p.doc_id, p.share, q.share AS highest, q.doc_id AS highest_doc, row_number() OVER (PARTITION BY p.doc_id, p.item_id ORDER BY q.share DESC, q.number, q.doc_id) AS k FROM p JOIN p q ON p.project_id = q.project_id AND p.item_number = q.item_number AND q.number < p.number)
SELECT project_id, item_number, item_id, doc_id, highest_doc, round(share, 6) AS share, round(highest, 6) AS highest, round(least(0.95, 0.75 + highest - share), 6) AS confidence FROM j WHERE k = 1 AND share < highest - 0.001""")
def completion_regressions(m):
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.concat((F.col("quantity") * 2).cast("string"), F.lit("%")).alias("percent_complete")))).otherwise(F.to_json(F.struct((F.col("quantity") / 50).alias("percent_complete"))))
    rows = m.items.filter("doc_type = 'payment_app'").select("project_id", "doc_id", "number", "item_number", "item_id", splits.percent_complete(text).alias("share"))
    found = splits.completion_regressions(rows)
    return found.select("project_id", "item_number", "item_id", "doc_id", "highest_doc", *(_r(F.col(c), c) for c in ("share", "highest", "confidence")))


# --- rules over documents and relations ------------------------------------------------------------------------------------


@query("""
, p AS (SELECT project_id, doc_id, date_created AS d, lead(doc_id) OVER w AS next_id, lead(date_created) OVER w AS until FROM docs WHERE doc_type = 'payment_app' WINDOW w AS (PARTITION BY project_id ORDER BY date_created, doc_id))
SELECT p.project_id, p.doc_id AS payment_id, next_id, string_agg(o.doc_id, ',' ORDER BY o.doc_id) AS orders, CAST(count(*) AS BIGINT) AS n FROM p JOIN docs o ON o.project_id = p.project_id AND o.doc_type = 'change_order' AND o.date_created > p.d AND o.date_created < until GROUP BY ALL""")
def orders_between_payments(m):
    found = network_rules.orders_between_payments(m.documents)
    return found.select("project_id", "payment_id", "next_id", F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("orders"), _l("n"))


@query("""
, t AS (SELECT project_id, year(date_created) || '-' || month(date_created) AS period FROM docs WHERE doc_type = 'change_order' AND day(date_created) >= 28
  UNION ALL SELECT project_id, year(date_created) || '-Q' || (month(date_created) // 3) FROM docs WHERE doc_type = 'change_order' AND day(date_created) >= 25 AND month(date_created) % 3 = 0)
SELECT project_id, period, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY project_id, period HAVING count(*) >= 2""")
def fiscal_clusters(m):
    return network_rules.fiscal_clusters(m.documents).select("project_id", "period", _l("n"))


@query(f""", {_PAIRS_SQL.strip()}
SELECT src AS source_doc_id, dst AS target_doc_id, kind AS relationship_type, CAST(date_diff('day', a.date_created, b.date_created) AS BIGINT) AS days FROM rel JOIN docs a ON a.doc_id = src JOIN docs b ON b.doc_id = dst WHERE a.date_created < b.date_created""")
def referenced_before_existing(m):
    return network_rules.referenced_before_existing(relationships.pair_rules(m.documents), m.documents).select("source_doc_id", "target_doc_id", "relationship_type", _l("days"))


@query(f""", {_PAIRS_SQL.strip()},
lk AS (SELECT DISTINCT src, dst FROM rel WHERE kind IN ('sequential', 'parent_child') UNION SELECT dst, src FROM rel WHERE kind IN ('sequential', 'parent_child')),
am AS (SELECT project_id, doc_id, c // 1000000 AS k FROM docs WHERE doc_type IN ('payment_app', 'invoice') UNION SELECT project_id, doc_id, c // 1000000 FROM items WHERE doc_type IN ('payment_app', 'invoice'))
SELECT am.project_id, am.doc_id AS payment_id, o.doc_id AS order_id, CAST(am.k * 100 AS BIGINT) AS cents, CASE WHEN o.status = 'rejected' THEN 'rejected_co_amount_in_payment' ELSE 'unlinked_matching_amount' END AS issue, CASE WHEN o.status = 'rejected' THEN 0.95::DOUBLE ELSE 0.85 END AS confidence
FROM am JOIN docs o ON o.project_id = am.project_id AND o.doc_type = 'change_order' AND o.c // 1000000 = am.k AND am.k > 0 WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.src = am.doc_id AND lk.dst = o.doc_id)""")
def unlinked_orders(m):
    """Amounts in steps of 10,000 here, as equal ones are rare, and the relations of numbers and dates only."""
    step = lambda c: F.floor(_c(c) / 1_000_000).cast("decimal(15,2)")
    some = relationships.pair_rules(m.documents).filter(F.col("relationship_type").isin("sequential", "parent_child"))
    return network_rules.unlinked_orders(m.items.withColumn("amount", step("amount")), m.documents.withColumn("total", step("total")), some).withColumn("confidence", F.col("confidence").cast("double"))


@query(f""", {_PAIRS_SQL.strip()},
md AS (SELECT *, doc_id % 11 = 0 AS flag, number % 4 AS ref, ['open', 'paid', 'void'][CAST(doc_id % 3 + 1 AS INT)] AS said FROM docs),
pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rel)
SELECT 'contradictory_approval' AS kind, doc_id, NULL::BIGINT AS other_id, NULL::VARCHAR AS reference, status, NULL::VARCHAR AS other_status FROM md WHERE flag
UNION ALL SELECT 'related_documents', a, b, NULL, x.status, y.status FROM pr JOIN md x ON x.doc_id = a JOIN md y ON y.doc_id = b WHERE (x.status = 'approved' AND y.status = 'rejected') OR (x.status = 'rejected' AND y.status = 'approved')
UNION ALL SELECT 'conflicting_reference_status', a, b, 'CO ' || x.ref, x.said, y.said FROM pr JOIN md x ON x.doc_id = a JOIN md y ON y.doc_id = b WHERE x.ref = y.ref AND x.said <> y.said""")
def contradictions(m):
    """Some documents carry the flag here, and each refers to a change order by its own number, with a status."""
    d = m.documents.withColumn("meta_data", F.to_json(F.struct((F.col("doc_id") % 11 == 0).alias("contradictory_approval"))))
    refs = m.documents.select("doc_id", F.concat(F.lit("CO "), (F.col("number") % 4).cast("string")).alias("reference"), F.element_at(F.array(F.lit("open"), F.lit("paid"), F.lit("void")), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"))
    return network_rules.contradictions(d, relationships.pair_rules(m.documents), refs).drop("confidence")


@query("""
, f AS (SELECT item_id, doc_id, project_id, c, description || CASE quantity % 5 WHEN 0 THEN ' special fee' WHEN 1 THEN ' surcharge' WHEN 2 THEN ' site supervision' ELSE '' END AS d FROM items),
ct AS (SELECT project_id, string_agg('provides for ' || CASE number % 3 WHEN 0 THEN 'supervision' WHEN 1 THEN 'a SURCHARGE' ELSE 'nothing' END, ' ') AS t FROM docs WHERE doc_type = 'contract' GROUP BY project_id),
w AS (SELECT item_id, doc_id, unnest(string_split(lower(d), ' ')) AS w, project_id FROM f),
ok AS (SELECT DISTINCT item_id, doc_id FROM w JOIN ct ON ct.project_id = w.project_id AND length(w) > 3 AND contains(lower(t), w))
SELECT f.item_id, f.doc_id, f.project_id, ok.item_id IS NOT NULL AS authorised, contains(d, 'special') AS modified, round(least(0.95, 0.8 + CASE WHEN c > 100000 THEN 0.05 ELSE 0 END + CASE WHEN contains(d, 'special') THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence
FROM f LEFT JOIN ok ON ok.item_id = f.item_id AND ok.doc_id = f.doc_id WHERE c > 10000 AND (contains(d, 'fee') OR contains(d, 'surcharge') OR contains(d, 'supervision')) AND (ok.item_id IS NULL OR contains(d, 'special'))""")
def unauthorised_fees(m):
    """Some items are named as fees here, and contracts provide for some."""
    q = F.col("quantity") % 5
    named = F.concat("description", F.when(q == 0, " special fee").when(q == 1, " surcharge").when(q == 2, " site supervision").otherwise(""))
    k = F.col("number") % 3
    contracts = m.documents.filter("doc_type = 'contract'").select("project_id", F.concat(F.lit("provides for "), F.when(k == 0, "supervision").when(k == 1, "a SURCHARGE").otherwise("nothing")).alias("text"))
    return network_rules.unauthorised_fees(m.items.withColumn("description", named), contracts).withColumn("confidence", _r(F.col("confidence")))


@query("""
, o AS (SELECT project_id, doc_id, (sum(c) / 100.0::DOUBLE) / (sum(quantity * uc) / 100.0::DOUBLE) * 100 - 100 AS markup, sum(quantity * uc) / 100.0::DOUBLE AS base FROM items WHERE doc_type = 'change_order' AND quantity > 0 GROUP BY project_id, doc_id),
a AS (SELECT project_id, max(number * 10.0::DOUBLE) AS allowed FROM docs WHERE doc_type = 'contract' GROUP BY project_id),
j AS (SELECT o.*, coalesce(allowed, 15.0) AS allowed FROM o LEFT JOIN a ON a.project_id = o.project_id)
SELECT project_id, doc_id, round(markup, 4) AS markup, allowed, round(base * (markup - allowed) / 100, 6) AS hidden, round(least(0.95, 0.7 + (markup - allowed) / 10), 6) AS confidence FROM j WHERE markup > allowed * 1.2::DOUBLE AND base <> 0""")
def excessive_markups(m):
    """A contract allows ten percent for each number here."""
    base = F.sum(F.col("quantity") * _c("unit_price")) / 100
    orders = m.items.filter("doc_type = 'change_order' AND quantity > 0").groupBy("project_id", "doc_id").agg(((F.sum(_c("amount")) / 100) / base * 100 - 100).alias("markup"), base.alias("base"))
    allowed = m.documents.filter("doc_type = 'contract'").select("project_id", (F.col("number") * 10.0).alias("allowed"))
    found = network_rules.excessive_markups(orders, allowed)
    return found.select("project_id", "doc_id", _r(F.col("markup"), "markup", 4), "allowed", _r(F.col("hidden"), "hidden"), _r(F.col("confidence"), "confidence"))


@query(f"""{_HOLIDAYS_SQL},
b AS (SELECT DISTINCT CAST(h.d + k AS DATE) AS d FROM h, (SELECT unnest([-1, 0, 1]) AS k) WHERE year(CAST(h.d + k AS DATE)) BETWEEN 1994 AND 2002),
n AS (SELECT count(*) AS documents, count(b.d) AS beside FROM docs LEFT JOIN b ON b.d = date_created WHERE year(date_created) BETWEEN 1994 AND 2002)
SELECT documents, beside, round(documents * (SELECT count(*) FROM b) / 3287.0::DOUBLE, 6) AS expected, beside > 1.5::DOUBLE * documents * (SELECT count(*) FROM b) / 3287.0::DOUBLE AS unusual FROM n WHERE documents >= 10""")
def holiday_share(m):
    return network_rules.holiday_share(m.documents, 1994, 2002).select("documents", "beside", _r(F.col("expected"), "expected"), "unusual")


@query("""
, v AS (SELECT item_id, doc_id, category || '/' || doc_type || '/' || party AS g, CASE WHEN quantity = 50 THEN 4 ELSE 1 END * c / 100.0::DOUBLE AS v FROM items),
s AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS std, row_number() OVER (PARTITION BY g ORDER BY v, item_id) - 1 AS k FROM v WINDOW w AS (PARTITION BY g)),
q AS (SELECT g, max(CASE WHEN k = n // 4 THEN v END) AS q1, max(CASE WHEN k = 3 * n // 4 THEN v END) AS q3 FROM s GROUP BY g),
z AS (SELECT item_id, doc_id, max(least(0.95, 0.7 + 0.1 * (abs((v - mean) / std) - 2.5))) AS z FROM s WHERE n >= 5 AND std > 0 AND std >= 0.01 * abs(mean) AND abs((v - mean) / std) > 2.5 GROUP BY ALL),
i AS (SELECT item_id, doc_id, max(least(0.95, 0.7 + 0.2 * (CASE WHEN v > q3 THEN v - q3 ELSE q1 - v END / (q3 - q1) - 1.5))) AS q FROM s JOIN q ON s.g = q.g WHERE n >= 5 AND q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) GROUP BY ALL)
SELECT coalesce(z.item_id, i.item_id) AS item_id, coalesce(z.doc_id, i.doc_id) AS doc_id, CASE WHEN z IS NULL THEN 'iqr' WHEN q IS NULL THEN 'z_score' ELSE 'iqr,z_score' END AS methods, round(coalesce(least(0.95, z + CASE WHEN q IS NULL THEN 0 ELSE 0.1 END), q)::DOUBLE, 6) AS confidence FROM z FULL JOIN i ON z.item_id = i.item_id AND z.doc_id = i.doc_id""")
def amount_outliers(m):
    """Items of the largest quantity count four times here, so that there are outliers."""
    rows = m.items.withColumn("amount", F.col("amount") * F.when(F.col("quantity") == 50, 4).otherwise(1))
    found = network_rules.amount_outliers(rows, ("category", "doc_type", "party"))
    return found.select("item_id", "doc_id", F.array_join("methods", ",").alias("methods"), _r(F.col("confidence"), "confidence"))


def _stated(m: Model) -> tuple[DataFrame, DataFrame]:
    """Items and documents with what they state in meta_data: some items' and documents' figures are off."""
    amount = F.col("amount").cast("double")
    off = lambda n, k: F.when(F.col("quantity") % n == 0, k).otherwise(0)
    said = F.struct((F.col("quantity") / 50).alias("percent_complete"), (amount * 50 / F.col("quantity") + off(7, 500)).alias("scheduled_value"), (off(11, -200) + 100.0).alias("previous_completed"))
    items = m.items.withColumns({"total": (F.col("amount") + 100 + off(5, 3)).cast("decimal(15,2)"), "meta_data": F.to_json(said)})
    money = F.col("total").cast("double")
    doc = F.struct(
        money.alias("completed_to_date"), (money * 0.05 + F.when(F.col("doc_id") % 3 == 0, 0).otherwise(900)).alias("retainage"), F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(0.05).alias("retainage_percent"), money.alias("total_earned_less_retainage"),
        F.lit(1000.0).alias("previous_certificates"), (money - F.when(F.col("doc_id") % 4 == 0, 9000).otherwise(1000)).alias("current_payment_due"), F.create_map(F.lit("ECONOMY"), F.lit(60000.0)).alias("category_totals"),
    )
    return items, m.documents.withColumn("meta_data", F.to_json(doc))


_STATED_SQL = """
, i AS (SELECT doc_id, item_id, category, c / 100.0::DOUBLE AS amount, quantity AS q, uc / 100.0::DOUBLE AS price, c / 100.0::DOUBLE + 100 + CASE WHEN quantity % 5 = 0 THEN 3 ELSE 0 END AS total FROM items),
d AS (SELECT doc_id, doc_type, party, c / 100.0::DOUBLE AS money FROM docs),
e AS (SELECT 'quantity_price' AS "check", doc_id, item_id, NULL::VARCHAR AS part, total AS stated, q * price AS expected, 0.01 AS lo, 0.0 AS sh, 0.95 AS c0, 0.98 AS c1, ['invoice', 'payment_app', 'change_order'] AS ty FROM i
  UNION ALL SELECT 'amount_total', doc_id, item_id, NULL, amount, total, 0.01, 0.0, 0.90, 0.95, ['invoice', 'payment_app', 'change_order'] FROM i
  UNION ALL SELECT 'percent_complete', doc_id, item_id, NULL, amount, q / 50.0::DOUBLE * (amount * 50 / q + CASE WHEN q % 7 = 0 THEN 500 ELSE 0 END), 0.1, 0.01, 0.90, 0.95, ['invoice', 'payment_app'] FROM i
  UNION ALL SELECT 'current_work', i.doc_id, item_id, NULL, amount, total - (100 - CASE WHEN q % 11 = 0 THEN 200 ELSE 0 END), 0.1, 0.01, 0.90, 0.95, ['payment_app'] FROM i JOIN d ON d.doc_id = i.doc_id AND doc_type = 'payment_app'
  UNION ALL SELECT 'category_total', doc_id, NULL, category, 60000, round(sum(amount), 2), 0.01, 0.01, 0.90, 0.95, ['invoice', 'payment_app', 'change_order'] FROM i WHERE category = 'ECONOMY' GROUP BY doc_id, category
  UNION ALL SELECT 'document_total', d.doc_id, NULL, 'completed_to_date', money, s, 0.01, 0.01, 0.95, 0.98, ['invoice', 'payment_app', 'change_order'] FROM d JOIN (SELECT doc_id, round(sum(amount), 2) AS s FROM i GROUP BY doc_id) t ON t.doc_id = d.doc_id
  UNION ALL SELECT 'retainage', doc_id, NULL, NULL, money * 0.05::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 900 END, money * 0.05::DOUBLE, 0.01, 0.01, 0.95, 0.98, ['payment_app'] FROM d
  UNION ALL SELECT 'payment_due', doc_id, NULL, NULL, money - CASE WHEN doc_id % 4 = 0 THEN 9000 ELSE 1000 END, money - 1000, 0.01, 0.01, 0.95, 0.98, ['payment_app'] FROM d),
f AS (SELECT e.*, d.party, d.party = 'BUILDING' AND list_contains(ty, d.doc_type) AND (CASE WHEN "check" = 'retainage' THEN stated < expected ELSE stated > expected END) AS benefits FROM e JOIN d ON d.doc_id = e.doc_id
  WHERE abs(stated - expected) > lo + 0.001 AND coalesce(abs(stated - expected) / nullif(greatest(abs(stated), abs(expected)), 0), 0) > sh)"""


@query(f"""{_STATED_SQL}
SELECT "check", doc_id, item_id, part, round(stated, 4) AS stated, round(expected, 4) AS expected, benefits, CASE WHEN benefits THEN c1 ELSE c0 END::DOUBLE AS confidence FROM f""")
def statement_errors(m):
    found = statements.statement_errors(*_stated(m), submitter="BUILDING")
    return found.select("check", "doc_id", "item_id", "part", _r(F.col("stated"), "stated", 4), _r(F.col("expected"), "expected", 4), "benefits", "confidence")


@query(f"""{_STATED_SQL}
SELECT party, CAST(count(*) AS BIGINT) AS n, round(least(0.95, 0.75 + 0.05 * count(*))::DOUBLE, 6) AS confidence FROM f WHERE benefits GROUP BY party HAVING count(*) >= 3""")
def systematic_errors(m):
    return statements.systematic_errors(statements.statement_errors(*_stated(m), submitter="BUILDING")).select("party", "n", _r(F.col("confidence"), "confidence"))


@query("""
, o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date_created, doc_id) AS k FROM docs WHERE doc_type = 'change_order')
SELECT min(CASE WHEN k = 1 THEN doc_id END) AS first, string_agg(doc_id, '>' ORDER BY k) AS orders, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS sum_cents FROM o GROUP BY project_id HAVING count(*) >= 3""")
def order_chains(m):
    found = statements.order_chains(relationships.pair_rules(m.documents), m.documents)
    return found.select("first", F.array_join(F.transform("orders", lambda x: x.cast("string")), ">").alias("orders"), "n", "sum_cents")


@query("""
SELECT category, CAST(count(*) AS BIGINT) AS n, round(min(uc) / 100.0::DOUBLE, 6) AS low, round(max(uc) / 100.0::DOUBLE, 6) AS high, round(sum(uc) / count(*) / 100.0::DOUBLE, 6) AS mean, round(stddev_pop(uc / 100.0::DOUBLE) / (sum(uc) / count(*) / 100.0::DOUBLE), 6) AS cv FROM lines GROUP BY category""")
def price_variance(m):
    found = agg.price_variance(m.line_items, ("category",), F.col("unit_price"))
    return found.select("category", "n", *(_r(F.col(c), c) for c in ("low", "high", "mean", "cv")))


@query(f""", {_PAIRS_SQL.strip()}
SELECT 'doc_' || src AS src, 'doc_' || dst AS dst, kind FROM rel UNION ALL SELECT DISTINCT 'item_' || item_id, 'doc_' || doc_id, 'belongs_to' FROM items""")
def financial_network(m):
    return graph.financial_network(m.documents, m.items, relationships.pair_rules(m.documents))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(f):
        return lambda spark, sf_dir: f(Model(spark, sf_dir))

    return {name: over(f) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
