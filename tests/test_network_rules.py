"""Rules over documents, statements and relations on rows typed by hand, at the thresholds they have by default."""

import datetime as dt
import json
from decimal import Decimal

import pytest

day = lambda m, d: dt.date(2023, m, d)
DOCS = "project_id int, doc_id long, doc_type string, status string, party string, date_created date, total decimal(15,2), meta_data string"


def _docs(spark, rows):
    return spark.createDataFrame([(p, i, t, s, "contractor", d, None if c is None else Decimal(c), m) for p, i, t, s, d, c, m in rows], DOCS)


def test_orders_between_payments_and_fiscal_clusters(spark):
    from tallyforge.operators import network_rules as n

    docs = _docs(spark, [
        (1, 1, "payment_app", None, day(1, 31), 1, None), (1, 2, "payment_app", None, day(3, 31), 1, None), (1, 3, "payment_app", None, day(5, 31), 1, None), (1, 4, "change_order", None, day(2, 28), 1, None),
        (1, 5, "change_order", None, day(3, 25), 1, None), (1, 6, "change_order", None, day(3, 31), 1, None), (1, 7, "change_order", None, day(6, 30), 1, None), (1, 8, "change_order", None, day(1, 31), 1, None),
        (1, 9, "change_order", None, None, 1, None), (2, 10, "change_order", None, day(3, 28), 1, None), (2, 11, "payment_app", None, day(3, 1), 1, None), (1, 12, "change_order", None, day(3, 29), 1, None),
    ])
    got = {(x["payment_id"], x["next_id"]): list(x["orders"]) for x in n.orders_between_payments(docs).collect()}
    assert got == {(1, 2): [4, 5, 12]}  # of the days of payments neither is between
    got = {(x["project_id"], x["period"]): x["n"] for x in n.fiscal_clusters(docs).collect()}
    assert got == {(1, "2023-Q1"): 3, (1, "2023-3"): 2}


def test_links_dates_and_contradictions(spark):
    from tallyforge.operators import network_rules as n

    docs = _docs(spark, [
        (1, 1, "change_order", "rejected", day(1, 1), "500.00", None), (1, 2, "payment_app", "approved", day(2, 1), "500.00", '{"contradictory_approval": true}'), (1, 3, "invoice", "approved", day(3, 1), "80.00", '{"contradictory_approval": false}'),
        (1, 4, "change_order", "approved", day(4, 1), "70.00", "no json"), (2, 5, "invoice", None, day(1, 1), "500.00", None), (1, 6, "change_order", None, None, "0.00", None),
    ])
    items = spark.createDataFrame([(1, 3, "i1", Decimal("70.00")), (1, 3, "i2", Decimal("500.00")), (1, 4, "i3", Decimal("500.00")), (1, 2, "i4", Decimal("0.00"))], "project_id int, doc_id long, item_id string, amount decimal(15,2)")
    rel = spark.createDataFrame([(1, 3, "related_invoice"), (2, 1, "x"), (4, 1, "y"), (4, 4, "z"), (6, 1, "u"), (5, 3, "v")], "source_doc_id long, target_doc_id long, relationship_type string")
    got = {(x["payment_id"], x["order_id"], x["cents"], x["issue"], float(x["confidence"])) for x in n.unlinked_orders(items, docs, rel).collect()}
    assert got == {(3, 4, 7000, "unlinked_matching_amount", 0.85)}  # 1 is related with 2 and 3
    got = {(x["payment_id"], x["order_id"], x["issue"]) for x in n.unlinked_orders(items, docs, rel.filter("relationship_type = 'x'")).collect()}
    assert got == {(3, 4, "unlinked_matching_amount"), (3, 1, "rejected_co_amount_in_payment")}
    got = {(x["source_doc_id"], x["target_doc_id"], x["days"]) for x in n.referenced_before_existing(rel, docs).collect()}
    assert got == {(1, 3, 59), (5, 3, 59)}
    refs = spark.createDataFrame([(1, "CO 7", "approved"), (3, "CO 7", "rejected"), (3, "CO 8", "x"), (1, "CO 8", None), (5, "CO 7", "void"), (2, "CO 9", "a")], "doc_id long, reference string, status string")
    got = {(x["kind"], x["doc_id"], x["other_id"], x["reference"], x["status"], x["other_status"]) for x in n.contradictions(docs, rel, refs).collect()}
    assert got == {
        ("contradictory_approval", 2, None, None, "approved", None), ("related_documents", 1, 3, None, "rejected", "approved"), ("related_documents", 1, 2, None, "rejected", "approved"),
        ("related_documents", 1, 4, None, "rejected", "approved"), ("conflicting_reference_status", 1, 3, "CO 7", "approved", "rejected"), ("conflicting_reference_status", 3, 5, "CO 7", "rejected", "void"),
    }


def test_fees_and_markups(spark):
    from tallyforge.operators import network_rules as n

    rows = [("a", "Bond Premium", "150"), ("b", "special bond fee", "2000"), ("c", "site overhead", "101"), ("d", "site overhead", "100"), ("e", "pipe", "5000"), ("f", "fee", "500"), ("g", None, "500"), ("h", "Administration misc", "1001")]
    items = spark.createDataFrame([(i, 1, 1, d, Decimal(c)) for i, d, c in rows] + [("z", 2, 2, "Bond premium", Decimal(500))], "item_id string, doc_id int, project_id int, description string, amount decimal(15,2)")
    contracts = spark.createDataFrame([(1, "The BOND is paid by the owner."), (1, None)], "project_id int, text string")
    got = {x["item_id"]: (x["authorised"], x["modified"], round(x["confidence"], 6)) for x in n.unauthorised_fees(items, contracts).collect()}
    assert got == {"b": (True, True, 0.95), "c": (False, False, 0.8), "f": (False, False, 0.8), "h": (False, True, 0.95), "z": (False, False, 0.8)}
    orders = spark.createDataFrame([(1, 1, 18.0, 1000.0), (1, 2, 18.1, 1000.0), (1, 3, 40.0, 0.0), (2, 4, 24.5, 200.0), (2, 5, None, 200.0)], "project_id int, doc_id int, markup double, base double")
    allowed = spark.createDataFrame([(2, 20.0), (2, 5.0)], "project_id int, allowed double")
    got = {x["doc_id"]: (x["allowed"], round(x["hidden"], 4), round(x["confidence"], 4)) for x in n.excessive_markups(orders, allowed).collect()}
    assert got == {2: (15.0, 31.0, 0.95), 4: (20.0, 9.0, 0.95)}


def test_holiday_share(spark):
    from tallyforge.operators import network_rules as n

    usual = [(1, k, "invoice", None, day(2, 1 + k % 20), 1, None) for k in range(8)]
    got = n.holiday_share(_docs(spark, usual + [(1, 100 + k, "invoice", None, day(7, 3 + k % 3), 1, None) for k in range(4)]), 2023, 2023).collect()
    assert [(x["documents"], x["beside"], x["unusual"]) for x in got] == [(12, 4, True)]
    assert n.holiday_share(_docs(spark, usual), 2023, 2023).count() == 0


def test_outliers_by_either_method(spark):
    from tallyforge.operators.network_rules import amount_outliers

    values = [100.0 + k % 7 for k in range(40)] + [100_000.0, 118.0]
    items = spark.createDataFrame([(f"i{k}", 1, None, "invoice", "p", Decimal(v)) for k, v in enumerate(values)] + [("lone", 1, "c", "invoice", "p", Decimal(9)), ("null", 1, None, "invoice", "p", None)], "item_id string, doc_id int, cost_code string, doc_type string, party string, amount decimal(15,2)")
    got = {x["item_id"]: (list(x["methods"]), round(x["confidence"], 6)) for x in amount_outliers(items).collect()}
    assert got == {"i40": (["iqr", "z_score"], 0.95), "i41": (["iqr"], pytest.approx(0.95, abs=0.26))}


def test_statement_errors(spark):
    from tallyforge.operators.statements import statement_errors, systematic_errors

    said = lambda **x: json.dumps(x)
    items = spark.createDataFrame(
        [
            ("right", 1, Decimal("100"), 10, Decimal("10"), Decimal("100"), "a", said(percent_complete="50%", scheduled_value=200, previous_completed=0)),
            ("priced", 1, Decimal("120"), 10, Decimal("10"), Decimal("120"), "a", None),
            ("amount", 2, Decimal("90"), None, None, Decimal("100"), "b", None),
            ("share", 2, Decimal("100"), None, None, None, "b", said(percent_complete=0.5, scheduled_value=190)),
            ("close", 2, Decimal("100"), None, None, None, "b", said(percent_complete=0.5, scheduled_value=199)),
            ("current", 1, Decimal("50"), None, None, Decimal("50"), None, said(previous_completed=10)),
            ("no payment", 3, Decimal("50"), None, None, Decimal("50"), None, said(previous_completed=10)),
        ],
        "item_id string, doc_id int, amount decimal(15,2), quantity int, unit_price decimal(15,2), total decimal(15,2), category string, meta_data string",
    )
    docs = spark.createDataFrame(
        [
            (1, "payment_app", "contractor", said(category_totals={"a": 230, "x": 1}, completed_to_date=270, total_completed="nothing", retainage=10, retainage_percent=5.0, total_earned_less_retainage=200, previous_certificates=150, current_payment_due=60)),
            (2, "correspondence", "contractor", said(completed_to_date=300, retainage=15, retainage_percent=0.05, category_totals={"b": "290"})),
            (3, "invoice", "owner", "no json"), (4, "invoice", "owner", None),
        ],
        "doc_id int, doc_type string, party string, meta_data string",
    )
    errors = statement_errors(items, docs)
    got = {(x["check"], x["doc_id"], x["item_id"], x["part"]): (round(x["stated"], 4), round(x["expected"], 4), x["benefits"], x["confidence"]) for x in errors.collect()}
    assert got == {
        ("quantity_price", 1, "priced", None): (120.0, 100.0, True, 0.98), ("amount_total", 2, "amount", None): (90.0, 100.0, False, 0.90), ("percent_complete", 2, "share", None): (100.0, 95.0, False, 0.90),
        ("current_work", 1, "current", None): (50.0, 40.0, True, 0.95), ("category_total", 1, None, "a"): (230.0, 220.0, True, 0.95), ("document_total", 2, None, "completed_to_date"): (300.0, 290.0, False, 0.95),
        ("retainage", 1, None, None): (10.0, 13.5, True, 0.98), ("payment_due", 1, None, None): (60.0, 50.0, True, 0.98),
    }
    assert [(x["party"], x["n"], x["confidence"]) for x in systematic_errors(errors).collect()] == [("contractor", 5, 0.95)]
    assert statement_errors(items.limit(0), docs.limit(0)).count() == 0


def test_order_chains(spark):
    from tallyforge.operators.statements import order_chains

    docs = _docs(spark, [(1, k, "change_order", None, day(1, 20 - k), "10.00", None) for k in range(1, 10)] + [(1, 20, "invoice", None, day(1, 1), "10.00", None)])
    rel = [(1, 2, 0.95), (2, 3, 0.95), (3, 4, 0.79), (2, 9, 0.9), (5, 6, 0.8), (6, 20, 0.95), (7, 7, 0.9)]
    got = order_chains(spark.createDataFrame([(a, b, "sequential", c) for a, b, c in rel], "source_doc_id long, target_doc_id long, relationship_type string, confidence double"), docs).collect()
    assert [(x["first"], list(x["orders"]), x["n"], x["sum_cents"], x["confidence"]) for x in got] == [(3, [3, 2, 1], 3, 3000, 0.9)]


def test_reports_of_the_whole_model(spark, tmp_path):
    """Every table of a financial report, and all that is known of an amount, over the smallest tables."""
    from tallyforge.operators import engine, relationships, reports
    from tallyforge.plans.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    rel = relationships.pair_rules(m.documents).drop("project_id")
    report = reports.financial_report(m.documents, m.items, rel)
    counts = {name: df.count() for name, df in report.items()}
    assert set(counts) >= {"patterns", "patterns_by_kind", "anomalies", "relationships", "evidence", "narrative"} and all(counts.values())
    assert counts["relationships"] == rel.count() and counts["patterns_by_kind"] <= counts["patterns"]
    amount = float(m.items.selectExpr("max(amount)").first()[0])
    known = engine.analyze_amount(m.items, m.documents, amount)
    assert {"matches", "history", "anomalies", "relations", "disputed"} == set(known)
    ids = {x["item_id"] for x in known["matches"].collect()}
    assert ids and known["history"].count() >= len(ids) and {x["subject"] for x in known["anomalies"].collect()} <= ids


def test_projects_descriptions_and_json(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyforge.functions.json import as_json
    from tallyforge.operators.lookups import description_similarity
    from tallyforge.operators.upserts import write_project

    rows = spark.createDataFrame([("a", 1, "Pipe and pump", Decimal("1.50"), day(1, 2)), ("b_2", 2, "pump", None, None), ("a", 3, "Pipe and pump", None, None)], "project_id string, doc_id int, description string, amount decimal(5,2), date date")
    at = str(tmp_path / "projects")
    write_project(rows, at)
    write_project(rows.filter("doc_id = 2"), at)
    assert sorted(p.name for p in (tmp_path / "projects").iterdir() if p.is_dir()) == ["project_id=a", "project_id=b_2"]
    assert spark.read.parquet(at).count() == 4
    with pytest.raises(Exception, match="no project name"):
        write_project(rows.withColumn("project_id", F.lit("../x")), at)
    got = {x["description"]: round(x["score"], 6) for x in description_similarity(rows, "the pump").collect()}
    assert got == {"Pipe and pump": 0.25, "pump": 0.5}
    assert [json.loads(x[0]) for x in rows.orderBy("doc_id").select(as_json("doc_id", "amount", "date")).collect()] == [{"doc_id": 1, "amount": 1.5, "date": "2023-01-02"}, {"doc_id": 2}, {"doc_id": 3}]


def test_all_detectors_together(spark):
    from tallyforge.operators import engine, outliers
    from tallyforge.plans.model import Model
    from tallyforge.plans.queries import _applications, _stated

    m = Model(spark, "/root/testdata/sf0.001")
    items, docs = _stated(m)
    share = m.items.filter("doc_type = 'payment_app'").selectExpr("project_id", "doc_id", "number", "item_number", "item_id", "quantity / 50.0D AS share")
    points = items.selectExpr("item_id AS id", "CAST(amount AS DOUBLE) AS a", "CAST(quantity AS DOUBLE) AS q")
    scores = outliers.isolation_scores(points, ["a", "q"], outliers.isolation_trees(points, ["a", "q"], trees=5, sample=32), sample=32)
    found = engine.all_anomalies(items, docs, _applications(m), share, scores, least=0.5)
    n = {x["kind"]: x["n"] for x in found.groupBy("kind").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert set(n) >= {"previous_certificate_mismatch", "payment_calculation_error", "decreasing_completion_percentage", "math_error_quantity_price", "math_error_retainage", "mismatched_total", "missing_change_order", "model_outlier"}
    assert found.filter("subject IS NULL OR confidence IS NULL OR confidence > 0.98 AND kind != 'model_outlier'").count() == 0
    assert n["decreasing_completion_percentage"] == engine.splits.completion_regressions(share).count()
    assert engine.rule_anomalies(items.limit(0), docs.limit(0)).count() == 0
