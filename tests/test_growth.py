"""Steps that once were repeated, or carried more than they need."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.operators import aggregates, disguised, engine, lookups, matching, rules, sequences, statements
from tallyforge.sources import extract


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_read_a_text_once(spark):
    d = spark.createDataFrame([(1, "We rejected Change Order #7. See invoice INV-9 and co 8."), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = extract.references(d)
    assert sorted((r["doc_id"], r["kind"], r["reference"], r["status"]) for r in found.collect() if r["kind"] != "invoice") == [(1, "change_order", "7", "rejected"), (1, "change_order", "8", None)]
    assert [r["reference"] for r in found.filter("kind = 'invoice'").collect()] == ["INV-9"]
    assert "Union" not in plan(found)


def test_table_items_read_lines_that_were_written(spark, monkeypatch):
    from tallyforge import storage

    written, keep = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name, **o: written.append(name) or keep(df, name, **o))
    d = spark.createDataFrame([(1, "Item | Qty | Rate | Amount\nPump | 2 | $1.50 | $3.00\nTotal | | | $3.00")], "doc_id long, text string")
    assert [(r["description"], r["quantity"], r["amount"]) for r in extract.table_items(extract.table_rows(d)).collect()] == [("Pump", 2.0, 3.0)]
    assert written == ["tables"]


def test_figures_are_parsed_once(spark):
    items = spark.createDataFrame([(1, "a", "x", 10.0, 2.0, 5.0, '{"percent_complete": "50%", "scheduled_value": 100, "previous_completed": 1}')], "doc_id long, item_id string, category string, amount double, quantity double, unit_price double, meta_data string")
    documents = spark.createDataFrame([(1, "payment_app", "contractor", '{"completed_to_date": 12, "retainage": 1, "retainage_percent": 10}', dt.date(2020, 1, 1))], "doc_id long, doc_type string, party string, meta_data string, date_created date")
    found = statements.statement_errors(items, documents)
    assert sorted((r["check"], r["stated"], round(r["expected"], 9)) for r in found.collect()) == [("document_total", 12.0, 10.0), ("percent_complete", 10.0, 50.0), ("retainage", 1.0, 1.2)]
    # Once for items, and once for each of the three uses of documents.
    assert found._jdf.queryExecution().analyzed().toString().lower().count("parse_json") <= 4


def test_quartiles_rank_values_alone(spark, monkeypatch):
    seen, keep = [], sequences.ranked
    monkeypatch.setattr(sequences, "ranked", lambda rows, *a, **o: seen.append(rows.columns) or keep(rows, *a, **o))
    rows = spark.createDataFrame([("g" if k % 2 else None, float(v), k) for k, v in enumerate([1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 90, 90])] + [("g", None, 99)], "g string, v double, id long")
    found = sequences.iqr_outliers(rows, "v", ("g",), "id")
    assert sorted((r["g"] or "", r["v"], r["id"], r["q1"], r["q3"], r["n"]) for r in found.collect()) == [("", 90.0, 10, 2.0, 5.0, 6), ("g", 90.0, 11, 2.0, 5.0, 6)]
    assert seen == [["g", "v"]]


def test_arithmetic_windows_look_ahead_once(spark):
    day = dt.date(2020, 1, 1)
    values = [10, 20, 30, 40, 41, 7, None, 7, 14, 21, 5, -5, -15, 99]
    days = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 10, 11, 12, 200]
    rows = spark.createDataFrame([("g", v, None if k is None else day + dt.timedelta(k), i) for i, (v, k) in enumerate(zip(values, days, strict=True))], "g string, v long, t date, id long")
    found = sequences.arithmetic_windows(rows.withColumn("at", F.coalesce("t", F.lit(dt.date(2020, 1, 10)))), ("g",), "v", "at", "id")
    assert sorted((r["first"], r["size"], r["mean_step"], round(r["confidence"], 6)) for r in found.collect()) == [(1, 3, 10.0, 0.9375), (1, 4, 10.0, 0.95), (2, 3, 10.0, 0.9375), (8, 3, 7.0, 0.9375), (11, 3, -10.0, 0.7875)]
    # One function for each row ahead and column, and one of the ranks; not a frame for each size and figure.
    assert plan(found).count("specifiedwindowframe(RowFrame") <= 17
    # Days that are missing are passed over; they come first in order.
    assert [(r["first"], r["size"], round(r["confidence"], 6)) for r in sequences.arithmetic_windows(spark.createDataFrame([("g", 1, None, 1), ("g", 2, day, 2), ("g", 3, day, 3), ("h", 1, None, 1), ("h", 2, None, 2), ("h", 3, None, 3)], "g string, v long, t date, id long"), ("g",), "v", "t", "id").collect()] == [(1, 3, 0.7875)]


def test_ranks_write_what_is_carried(spark, monkeypatch):
    from tallyforge.operators import ordered

    written, keep = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, name, **o: written.append(df.columns) or keep(df, name, **o))
    rows = spark.createDataFrame([("a", 3, "z"), ("a", 3, "y"), (None, 1, "x")], "g string, v long, id string")
    assert sorted((r["g"] or "", r["v"], r["rank"]) for r in ordered.ranked(rows, ("g",), "v", "id", carry=("g", "v")).collect()) == [("", 1, 0), ("a", 3, 0), ("a", 3, 1)]
    assert written == [["g", "v", "_at"]]


def test_matches_meet_once_in_bins_of_cents(spark):
    rows = [(1, "a", 1, 1.0049), (1, "b", 2, 0.9951), (1, "c", 3, 1.01), (1, "d", 3, 1.00), (1, "e", None, 1.00), (2, "f", 4, 1.00), (1, "g", 5, -1.00), (1, "h", 6, 99.00), (1, "i", 7, 100.00), (1, "j", 8, 98.01)]
    df = spark.createDataFrame(rows, "project_id long, item_id string, doc_id long, amount double").withColumn("date_created", F.lit(dt.date(2020, 1, 1)))
    found = matching.item_matches(df)
    pairs = sorted((r["a_item_id"], r["b_item_id"]) for r in found.collect())
    both = lambda *p: [x for a, b in p for x in ((a, b), (b, a))]
    # 100.00 and 99.00 are within 1 % of the greater alone, so only that comes first.
    assert pairs == sorted(both("ab", "ad", "bd", "ac", "bc") + [("i", "h"), ("h", "j")])
    assert found.columns == ["project_id", *(s + c for s in ("a_", "b_") for c in ("item_id", "doc_id", "date_created", "c"))]


def test_registered_matches_are_read_once(spark):
    m = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), (None, "a"), ("d", None)], "source_item_id string, target_item_id string")
    found = lookups.registered_matches(m, spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "item_id string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), (None, "a")]))
    assert plan(found).count("LogicalRDD") == 3


def test_shared_amounts_count_documents_without_repeated_rows(spark):
    rows = [(5, 1, "x"), (5, 1, "y"), (5, 1, "x"), (5, 2, "x"), (5, None, None), (7, 3, "x"), (7, 3, None), (None, 4, "z"), (None, 4, "z"), (9, 8, "x")]
    found = aggregates.matching_amounts(spark.createDataFrame(rows, "a long, doc_id long, doc_type string"), F.col("a"))
    assert sorted((r["key"] or 0, r["n"], r["documents"], r["types"]) for r in found.collect()) == [(0, 2, 1, 1), (5, 5, 2, 2), (7, 2, 1, 1)]
    assert "Expand" not in plan(found)


def test_terms_are_those_of_documents_in_sets(spark, monkeypatch):
    written, keep = {}, disguised.stored
    monkeypatch.setattr(disguised, "stored", lambda df, name, **o: written.setdefault(name, keep(df, name, **o)))
    rows = [(1, 1, "rejected", 20_000.0), (1, 2, "approved", 20_100.0), (1, 3, "approved", 19_000.0), (1, 4, "approved", 100.0)]
    docs = spark.createDataFrame(rows, "project_id long, doc_id long, status string, total double").withColumn("doc_type", F.lit("change_order"))
    terms = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["x"]), (4, ["a"]), (5, ["a"])], "doc_id long, terms array<string>")
    found = disguised.split_rejections(docs, least=10_000, most=50_000, per_mille=10, parts=1, terms=terms)
    assert [(r["parts"], r["shared"], round(r["confidence"], 6)) for r in found.collect()] == [([2], 1, 0.85)]
    assert sorted(r["doc_id"] for r in written["terms"].collect()) == [1, 2]


def test_detectors_read_items_that_were_written(spark):
    from tallyforge.plans.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    found = engine.suspicious_patterns(m.documents, m.items)
    assert "l_extendedprice" not in plan(found) and found.filter("kind = 'recurring_amount'").limit(1).count() == 1


def test_item_ids_are_made_after_joins(spark):
    from tallyforge.plans.model import Model

    p = plan(Model(spark, "/root/testdata/sf0.001").items.select("item_id", "project_id"))
    assert p.index("md5") < p.index("Join")


def test_reappearing_amounts_meet_in_wide_bins(spark):
    cents = [-33, -32, -31, -2, -1, 0, 1, 2, 30, 31, 32, 33, 63, 64, 65, 95, 96, 97, 200]
    rows = [(1, f"{k}{c}", day, c / 100, status) for c in cents for k, day, status in (("r", dt.date(2020, 1, 1), "rejected"), ("l", dt.date(2020, 1, 2), "approved"))]
    items = spark.createDataFrame(rows, "project_id long, item_id string, date_created date, amount double, status string").withColumns({"doc_id": F.lit(1), "doc_type": F.lit("x"), "item_status": F.col("status"), "description": F.lit("a b")})
    for tolerance in (0, 1, 7):
        found = rules.reappearing_amounts(items, tolerance)
        assert {r["item_id"]: r["n"] for r in found.collect()} == {f"r{c}": sum(abs(c - d) <= tolerance for d in cents) for c in cents}
    assert "array_distinct" in plan(found)


def _greedy(rows, share):
    taken = []
    for row in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        near = [c for c in taken if c[0] == row[0] and abs(c[1] - row[1]) < 9]
        common = [(min(row[1] + row[2], c[1] + c[2]) - max(row[1], c[1]), min(row[2], c[2])) for c in near]
        if not any(k > 0 and k >= share * n for k, n in common):
            taken.append(row)
    return {x[:3] for x in taken}


def test_long_runs_of_spans_are_shortened(spark, monkeypatch):
    """A chain of equal priority over many blocks takes one round; runs that are broken in all ways are decided as one by one."""
    import random

    from tallyforge.operators import detectors

    written, keep = [], detectors.stored
    monkeypatch.setattr(detectors, "stored", lambda df, name, **o: written.append((name, out := keep(df, name, **o))) or out)
    schema = "g string, first long, size long, p double"
    chain = [("a", k, 9, 0.95) for k in range(3000)]
    got = detectors.drop_overlaps(spark.createDataFrame(chain, schema), ("g",), "first", "size", [F.desc("p")], block=400, cell=1000)
    assert sorted(x["first"] for x in got.collect()) == list(range(0, 3000, 5))
    assert [name for name, _ in written].count("chosen") == 1 and next(df for name, df in written if name == "spans").count() < 150

    r = random.Random(7)
    rows = []
    for g in ("a", None, "c", "d"):
        at = 0
        while at < 500:
            n, s, p = r.choice([1, 3, 20, 60, 90, 150]), r.randrange(3, 10), r.choice([0.7, 0.8, 0.9])
            rows += [(g, at + k, s, p + {"c": 1e-4 * k, "d": -1e-4 * k}.get(g, 0.0)) for k in range(n)]
            rows += [(g, at + k, r.randrange(3, 10), r.choice([0.6, 0.8, 0.95])) for k in range(0, n, r.choice([7, 40, 200])) if r.random() < 0.4]
            at += n + r.choice([0, 0, 0, 1, 12])
    rows = [x for i, x in enumerate(rows) if x[:3] not in {y[:3] for y in rows[:i]}]
    df = spark.createDataFrame(rows, schema)
    for share, cell, block in ((0.5, 128, 70), (0.0, 1000, 1 << 17), (1.0, 200, 300)):
        written.clear()
        got = [(x["g"], x["first"], x["size"]) for x in detectors.drop_overlaps(df, ("g",), "first", "size", [F.desc("p")], share, block=block, cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == _greedy(rows, share)
        assert next(df for name, df in written if name == "spans").count() < len(rows)


def test_best_clusters_are_chosen_in_their_rows(spark):
    import random

    r = random.Random(2)
    rows = [(g, 1000 * n + k, dt.date(2020, 1, 1) + dt.timedelta(r.randrange(n))) for g, n, m in (("a", 40, 60), (None, 9, 30), ("c", 300, 20)) for k in range(m)]
    df = spark.createDataFrame([*rows, ("c", 1, None)], "party string, doc_id long, date_created date")
    best = sequences.best_event_clusters(df)
    assert "Expand" not in plan(best) and plan(best).count("Generate") == 1  # that of blocks alone
    old = sequences.best_clusters(sequences.event_clusters(df))
    assert sorted(map(str, best.select(old.columns).collect())) == sorted(map(str, old.collect()))
    place = {x[1]: i for g in ("a", None, "c") for i, x in enumerate(sorted((x for x in [*rows, ("c", 1, None)] if x[0] == g), key=lambda x: (x[2] or dt.date.min, x[1])))}
    assert all(x["first"] == place[x["doc_id"]] for x in best.collect())


def test_anomalies_read_items_that_were_written(spark):
    from tallyforge.plans.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    found = engine.anomalies(m.items, m.documents)
    assert "l_extendedprice" not in plan(found) and found.filter("kind = 'missing_change_order'").limit(1).count() == 1


def test_items_without_change_orders_are_shuffled_once(spark):
    day = lambda k: dt.date(2020, 1, k)
    items = spark.createDataFrame([(1, "a", 10, "invoice", 6000.0, day(5)), (1, "a", 10, "invoice", 6000.0, day(5)), (1, "b", 10, "invoice", 6100.0, day(5)), (2, "c", 20, "payment_app", 6000.0, day(5)), (1, "d", 11, "invoice", 8000.0, day(5)), (1, "e", 11, "invoice", 8000.0, day(1))], "project_id long, item_id string, doc_id long, doc_type string, amount double, date_created date").withColumn("description", F.lit("x"))
    documents = spark.createDataFrame([(1, "change_order", "approved", 6010.0, day(4)), (1, "change_order", "rejected", 8010.0, day(4)), (1, "change_order", "rejected", 8020.0, day(4)), (1, "change_order", "approved", 6100.0, day(6))], "project_id long, doc_type string, status string, total double, date_created date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rules.missing_change_orders(items, documents)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted((r["item_id"], r["orders"], r["kind"]) for r in found.collect()) == [("b", 0, "no change order"), ("c", 0, "no change order"), ("d", 2, "rejected change order"), ("e", 0, "no change order")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.columns == ["project_id", "doc_id", "item_id", "description", "amount", "orders", "valid", "kind", "confidence"]


def test_roundness_is_one_short_expression(spark):
    from tallyforge.functions.amounts import ROUNDNESS, roundness

    amounts = [(x,) for x in (100_000, 250_000, 50_000, 7_000, 500, 5, 4, 0, -500, 11_111, 11_111.5, 999, 1_999.97, 1_234.56, 15, None)]
    df = spark.createDataFrame([(None if x is None else float(x),) for (x,) in amounts], "a double").select(roundness(F.col("a")).alias("r"), "a")
    want = {None: 0, 100_000: 0.95, 250_000: 0.925, 50_000: 0.905, 7_000: 0.7507, 500: 0.70005, 5: 0.4500005, 4: 0, 0: 0, -500: 0, 11_111: 0.7011111, 11_111.5: 0.56088892, 999: 0.6000999, 1_999.97: 0.48015999760, 1_234.56: 0, 15: 0.4500015}
    assert {r["a"]: round(r["r"], 7) for r in df.collect()} == {k: round(v, 7) for k, v in want.items()}
    assert df.select("r")._jdf.queryExecution().analyzed().toString().count("CASE WHEN") <= 12 < 2 * len(ROUNDNESS)
