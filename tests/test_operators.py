"""Operators on small frames with values typed by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import amounts, dates, texts
from tallyforge.operators import graph, lookups, matching, relationships, search, sequences, upserts
from tallyforge.operators.registry import Registry, copy_project, in_projects
from tallyforge.schema import KEYS, TABLES
from tallyforge.sources import extract, files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,value", [("$1,234.50", 1234.5), ("(500)", -500.0), ("€ 12", 12.0), ("none", None), ("", None)])
def test_normalize_amount(spark, text, value):
    assert one(spark, amounts.normalize_amount(F.lit(text))) == value


@pytest.mark.parametrize("text,day", [("2023-01-15", dt.date(2023, 1, 15)), ("January 5, 2023", dt.date(2023, 1, 5)), ("3/4/2023", dt.date(2023, 3, 4)), ("25/4/2023", dt.date(2023, 4, 25)), ("soon", None)])
def test_parse_date(spark, text, day):
    assert one(spark, dates.parse_date(F.lit(text))) == day


@pytest.mark.parametrize("amount,low,high", [("10000.00", 0.85, 0.95), ("500.00", 0.7, 0.75), ("1234.56", 0, 0), ("11111.00", 0.7, 0.8), ("9999.99", 0.45, 0.65), ("100000.00", 0.95, 0.95)])
def test_roundness(spark, amount, low, high):
    assert low <= one(spark, amounts.roundness(F.lit(Decimal(amount)))) <= high


def test_money_columns(spark):
    assert one(spark, amounts.format_currency(F.lit(1234.5))) == "$1,234.50" and one(spark, amounts.format_currency(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, amounts.round_to_nearest(F.lit(2.5), 1)) == 2.0 and one(spark, amounts.percentage(F.lit(1), F.lit(0))) is None
    assert one(spark, amounts.within_rel(F.lit(Decimal("101.00")), F.lit(Decimal("100.00")))) and not one(spark, amounts.within_rel(F.lit(Decimal("101.01")), F.lit(Decimal("100.00"))))
    assert one(spark, texts.confidence_level(F.lit(0.75))) == "High" and one(spark, texts.severity_level(F.lit(0.1))) == "Negligible"


def test_bins_hold_every_pair_within_tolerance(spark):
    values = [Decimal(i) / 100 for i in range(9_900, 10_200)]
    rows = [(1, f"i{i}", i, dt.date(2023, 1, 1), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "project_id int, item_id string, doc_id int, date_created date, amount decimal(15,2)")
    got = {(r["a_item_id"], r["b_item_id"]) for r in matching.item_matches(df).collect()}
    want = {(f"i{i}", f"i{j}") for i, a in enumerate(values) for j, b in enumerate(values) if i != j and abs(a - b) * 100 <= a}
    assert got == want


def test_read_only():
    for ok in ("SELECT 1", " with x as (select 1) select * from x", "-- c\nselect 1 /* drop */"):
        assert lookups.is_read_only(ok)
    for bad in ("DELETE FROM t", "select 1; drop table t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "selection", "", "select 'update'"):
        assert not lookups.is_read_only(bad)


def test_run_sql(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert lookups.run_sql(spark, "SELECT count(*) AS n FROM five WHERE id >= :low", {"low": 3}).first()["n"] == 2
    with pytest.raises(ValueError):
        lookups.run_sql(spark, "DROP VIEW five")


def test_similarity(spark):
    a, b = F.lit("Foundation Work, north"), F.lit("foundation work")
    assert one(spark, texts.jaccard(texts.word_set(a), texts.word_set(b))) == pytest.approx(2 / 3)
    assert one(spark, texts.jaccard(texts.word_set(F.lit("")), texts.word_set(F.lit(None).cast("string")))) == 0
    assert one(spark, texts.blended_similarity(F.lit("hvac unit"), F.lit("mechanical unit"))) > 0.3
    assert one(spark, texts.suspiciousness(F.lit("misc"), F.lit(1.0))) == pytest.approx(0.9) and one(spark, texts.suspiciousness(F.lit(None).cast("string"), F.lit(1.0))) == 0.9


def test_graph(spark):
    e = spark.createDataFrame([("doc1", "doc2"), ("doc2", "doc3"), ("doc3", "doc1"), ("doc4", "doc5"), ("doc5", "doc4")], "src string, dst string")
    assert {tuple(r["path"]) for r in graph.cycles(e, 3).collect()} == {("doc1", "doc2", "doc3"), ("doc4", "doc5")}
    v = spark.createDataFrame([("doc1",), ("doc9",)], "id string")
    assert [r["id"] for r in graph.isolated(v, e).collect()] == ["doc9"]
    assert [r["path"] for r in graph.paths(e, "doc1", "doc3").collect()] == [["doc1", "doc2", "doc3"]]
    assert {r["id"]: r["depth"] for r in graph.neighbours(e, "doc1", 2).collect()} == {"doc2": 1, "doc3": 2}


def test_pair_rules(spark):
    d = dt.date
    rows = [(1, 1, "change_order", "rejected", d(2023, 1, 1), 1, "a"), (2, 1, "correspondence", "rejected", d(2023, 1, 20), 1, "b"), (3, 1, "payment_app", "approved", d(2023, 2, 1), 1, "c"), (4, 1, "payment_app", "approved", d(2023, 3, 1), 2, "d"), (5, 2, "invoice", "approved", d(2023, 1, 2), 1, "e"), (6, 1, "contract", "approved", d(2023, 1, 1), 1, "f"), (7, 1, "contract", "approved", d(2023, 1, 9), 2, "f_rev")]
    docs = spark.createDataFrame(rows, "doc_id long, project_id long, doc_type string, status string, date_created date, number long, file_name string")
    got = {(r["source_doc_id"], r["target_doc_id"], r["relationship_type"]) for r in relationships.pair_rules(docs).collect()}
    assert {(1, 2, "rejection"), (1, 2, "approval"), (1, 3, "referenced_in"), (1, 3, "rejected_reappearing"), (3, 4, "sequential"), (6, 7, "revision")} <= got and not any(5 in x for x in got)
    chains = {tuple(r["chain"]) for r in relationships.chains(relationships.pair_rules(docs)).collect()}
    assert (3, 4) in chains


def test_runs_and_gaps(spark):
    rows = [(1, i, dt.date(2023, 1, 1) + dt.timedelta(days=k), Decimal(v)) for i, (k, v) in enumerate([(0, 10), (5, 20), (9, 30), (20, 5), (21, 6), (200, 7)])]
    docs = spark.createDataFrame(rows, "project_id long, doc_id long, date_created date, total decimal(15,2)")
    runs = sequences.monotone_runs(docs, ("project_id",), "total", "date_created", "doc_id").collect()
    assert [(r["n"], r["low"]) for r in runs] == [(3, Decimal(10))]
    assert [r["gap"] for r in sequences.gaps(docs).collect()] == [179]


def test_upserts(spark):
    known = spark.createDataFrame([("h1", 1)], "file_hash string, v int")
    fresh = spark.createDataFrame([("h1", 2), ("h2", 4), ("h2", 3)], "file_hash string, v int")
    assert sorted(map(tuple, upserts.insert_absent(known, fresh, ("file_hash",), "v").collect())) == [("h1", 1), ("h2", 3)]
    rows = spark.createDataFrame([("d", "a", None, 1), ("d", None, "y", 2)], "doc_id string, p string, q string, version int")
    assert tuple(upserts.merged(rows, ("doc_id",), "version").first()) == ("d", "a", "y", 2)
    assert upserts.latest(rows, ("doc_id",), "version").first()["q"] == "y"
    gone = spark.createDataFrame([("d",)], "doc_id string")
    assert upserts.hard_delete({"t": rows, "u": known}, gone)["t"].count() == 0
    docs = spark.createDataFrame([("d", "active"), ("e", "active")], "doc_id string, status string")
    assert dict(map(tuple, upserts.soft_delete(docs, gone).collect())) == {"d": "deleted", "e": "active"}


def test_schemas(spark):
    for name, ddl in TABLES.items():
        assert spark.createDataFrame([], ddl).columns
        assert set(KEYS.get(name, ())) <= set(spark.createDataFrame([], ddl).columns)


PAY_APP = """APPLICATION FOR PAYMENT
APPLICATION NO: 01
DATE: January 15, 2023
CONTRACT SUM: $4,250,000.00
COMPLETED TO DATE: $235,750.00
RETAINAGE (5%): $11,787.50
LESS PREVIOUS CERTIFICATES: $0.00
CURRENT PAYMENT DUE: $223,962.50

1.0 | General Conditions | $10,000.00
2.0 | Site Preparation | $38,250.00
Total | Everything | $48,250.00
Status: approved
"""


def test_extraction(spark):
    docs = spark.createDataFrame([(1, PAY_APP), (2, None), (3, "CHANGE ORDER NO: CO-7\nnot approved")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in extract.metadata(docs).collect()}
    assert (got[1]["doc_type"], got[1]["number"], got[1]["document_date"], got[1]["n_amounts"], got[1]["approval"]) == ("payment_app", "01", "January 15, 2023", 8, "approved")
    assert (got[3]["doc_type"], got[3]["number"], got[3]["approval"]) == ("change_order", "CO-7", "rejected")
    c = extract.financial_checks(docs).filter("doc_id = 1").first()
    assert c["retainage_ok"] and c["due_ok"] and c["balance_ok"] is None
    assert [(r["description"], r["amount"]) for r in extract.line_items(docs).filter("doc_id = 1").orderBy("line").collect()][-2:] == [("General Conditions", 10000.0), ("Site Preparation", 38250.0)]
    rows = extract.table_rows(docs).filter("doc_id = 1").orderBy("line").collect()
    assert [r["cells"][0] for r in rows] == ["1.0", "2.0", "Total"] and len({r["block"] for r in rows}) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("same")
    (tmp_path / "b.txt").write_text("same")
    (tmp_path / "c.PDF").write_bytes(b"%PDF")
    f = files.read_files(spark, str(tmp_path))
    assert {r["format"] for r in f.collect()} == {"text", "pdf"}
    assert files.new_files(f, spark.createDataFrame([], "file_hash string")).count() == 2
    assert {r["text"] for r in files.texts(f).collect()} == {"same"}


def test_stream(spark, tmp_path):
    from tallyforge.streaming.ingest import bursts, file_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("same")
    (src / "b.txt").write_text("same")
    q = file_stream(spark, str(src)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 1
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "x"), (dt.datetime(2024, 1, 1, 7), "x")], "ts timestamp, event_type string")
    assert sorted(r["n"] for r in bursts(e).collect()) == [2, 2]


def test_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "b"), (3, [0.0, 0.0], "a")], "vec_id long, embedding array<float>, kind string")
    assert [r["vec_id"] for r in search.vector_search(v, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [r["vec_id"] for r in search.vector_search(v, [1.0, 0.0], 5, 0.5, filters={"kind": "b"}).collect()] == [2]
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, query array<double>")
    assert search.vector_ranks(v, q, 1).first()["vec_id"] == 2
    assert search.stored_vectors(v, spark.createDataFrame([(1, [0.0, 1.0], "z"), (5, [1.0], "z")], v.schema), 2).count() == 3
    text = " ".join(f"word{i}" for i in range(400))
    c = search.chunks(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in c} == {1} and max(r["chunk_length"] for r in c) <= 1000 and c[0]["chunk"].startswith("word0") and c[-1]["chunk"].endswith("word399")


def test_registry(spark):
    r = Registry()
    r.register("copy", copy_project, "rows under another project")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, x string")
    assert r.names() == {"copy": "rows under another project"} and r.run("copy", df, source=1, target=7).first()["project_id"] == 7
    assert in_projects(df, [2]).count() == 1 and in_projects(df).count() == 2
    with pytest.raises(ValueError):
        r.register("copy", copy_project)


def test_reports(spark, tmp_path):
    from tallyforge.operators import engine, reports
    from tallyforge.plans.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    tables = reports.sheets(m.documents, m.items)
    reports.write_sheets({"by_type": tables["by_type"]}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/by_type").count() == 5
    text = reports.markdown("Summary", {"summary": tables["summary"]})
    assert text.startswith("# Summary") and "| documents |" in text
    assert "occurs" in reports.amount_sentence(m.items, 900.0).first()["text"]
    found = engine.anomalies(m.items, m.documents).filter("kind = 'missing_change_order'")
    assert reports.evidence(found, m.items).filter("evidence = 'evidence_1'").count() == 1
    parts = engine.analyze_document(m.documents, m.items, relationships.pair_rules(m.documents), 14)
    assert set(parts) == {"items", "anomalies", "relationships", "timeline"} and parts["timeline"].count() >= 1


def test_eigenvector(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4)]
    got = {r["id"]: r["score"] for r in graph.eigenvector(spark.createDataFrame(edges, "src long, dst long"), 6).collect()}
    x = dict.fromkeys((1, 2, 3, 4), 1.0)
    for _ in range(6):
        y = {i: x[i] + sum(x[a] for a, b in edges if b == i) for i in x}
        n = sum(v * v for v in y.values()) ** 0.5
        x = {i: v / n for i, v in y.items()}
    assert got == pytest.approx(x)


def test_drop_overlaps(spark):
    import random

    from tallyforge.operators.detectors import drop_overlaps

    r = random.Random(3)
    rows = [(g, r.randrange(60), r.randrange(3, 10), r.random()) for g in "ab" for _ in range(60)]
    got = {tuple(x) for x in drop_overlaps(spark.createDataFrame(rows, "g string, first long, size long, p double"), ("g",), "first", "size", [F.desc("p")]).collect()}
    want = set()
    for row in sorted(rows, key=lambda x: -x[3]):
        common = [min(row[1] + row[2], c[1] + c[2]) - max(row[1], c[1]) for c in want if c[0] == row[0]]
        sizes = [min(row[2], c[2]) for c in want if c[0] == row[0]]
        if not any(k > 0 and k >= 0.5 * s for k, s in zip(common, sizes)):
            want.add(row)
    assert got == want


def test_scope_restoration(spark):
    from tallyforge.operators.detectors import hidden_fees, metadata_math, scope_restoration

    d = dt.date
    docs = spark.createDataFrame([(1, 1, "change_order", "rejected", d(2023, 1, 1), Decimal(1000)), (2, 1, "change_order", "approved", d(2023, 2, 1), Decimal(600)), (3, 1, "change_order", "approved", d(2023, 3, 1), Decimal(300)), (4, 1, "change_order", "approved", d(2022, 3, 1), Decimal(300))], "doc_id long, project_id long, doc_type string, status string, date_created date, total decimal(15,2)")
    items = spark.createDataFrame([(i, "change_order", t, Decimal(200)) for i, t in ((1, "hvac equipment unit"), (2, "mechanical equipment unit"), (3, "landscape"), (4, "hvac equipment unit"))], "doc_id long, doc_type string, description string, amount decimal(15,2)")
    r = scope_restoration(docs, items).collect()
    assert [(x["rejected_id"], x["orders"], x["percent"]) for x in r] == [(1, 1, 60.0)]
    fees = spark.createDataFrame([("Additional admin fee", Decimal(500)), ("Overhead", Decimal(500)), ("Steel", Decimal(500))], "description string, amount decimal(15,2)")
    assert {x["description"]: x["suspicious"] for x in hidden_fees(fees).collect()} == {"Additional admin fee": True, "Overhead": False}
    meta = spark.createDataFrame([(1, '{"line_items": [{"quantity": 2, "unit_price": 5, "total": 10}, {"quantity": 2, "unit_price": 5, "total": 11}], "original_contract": "100", "change_orders": 5, "adjusted_contract": 106}'), (2, "no json"), (3, None)], "doc_id long, meta_data string")
    assert sorted(x["check"] for x in metadata_math(meta).collect()) == ["adjusted_contract", "line_item"]


def test_json(spark):
    from tallyforge.functions import json

    assert one(spark, json.safe_get(F.lit('{"a": {"b": 3}}'), "a.b")) == "3" and one(spark, json.safe_get(F.lit("x"), "a", "none")) == "none" and one(spark, json.number_at(F.lit('{"a": "1.5"}'), "a")) == 1.5
    assert one(spark, json.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3} and one(spark, json.as_list(F.lit(None).cast("int"))) == []


def test_fields_and_embeddings(spark):
    docs = spark.createDataFrame([(1, PAY_APP), (2, "Dear Sir\nFrom: A. Owner\nTo: B. Builder\nSubject: Delay\n"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["fields"] for r in extract.fields(docs).collect()}
    assert got[1]["application_number"] == "01" and got[2]["subject"] == "Delay" and got[2]["sender"] == "A. Owner" and got[3] == {}
    v = {r["doc_id"]: r["e"] for r in docs.select("doc_id", extract.embed(F.col("text"), 8).alias("e")).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and len(v[3]) == 8 and v[1] != v[2]


def test_holidays(spark):
    got = {(r["name"], r["day"]) for r in dates.holidays(spark, 2023, 2023).collect()}
    assert {("Memorial Day", dt.date(2023, 5, 29)), ("Labor Day", dt.date(2023, 9, 4)), ("Thanksgiving", dt.date(2023, 11, 23)), ("Day after Thanksgiving", dt.date(2023, 11, 24))} <= got and len(got) == 9


def test_recurring_amounts_with_many_descriptions(spark):
    """Over 64 descriptions, every pair of which is alike; the same with one that differs; and with two that differ only from each other."""
    from tallyforge.operators import aggregates

    def row(c, text, kind="invoice"):
        return c, text, kind, "owner", 1

    many = [f"site rental unit trailer x{i}" for i in range(150)]
    rows = [row(100, t) for t in many] + [row(200, t, ["invoice", "contract"][i % 2]) for i, t in enumerate(many)] + [row(300, t) for t in [*many, "paint"]]
    rows += [row(400, t) for t in ["a b c d e f g h i j", "a b c d e f g h k l", "a b c d e f i j m n"]] + [row(500, t, k) for t, k in [("a b", "invoice"), ("b a", "contract"), ("a b", "invoice")]]
    items = spark.createDataFrame(rows, "amount long, description string, doc_type string, party string, doc_id long")
    got = {r["key"]: (r["n"], r["alike"]) for r in aggregates.recurring_amounts(items, F.col("amount")).collect()}
    assert got == {200: (150, True), 300: (151, False), 400: (3, False), 500: (3, True)}


def test_ranked_and_blocked_windows(spark):
    """Ranks and windows of groups that lie in many partitions, null groups and ties of the first key included."""
    import random

    from pyspark.sql.window import Window

    from tallyforge.operators.ordered import blocked, ranked

    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.randrange(40), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {x["id"]: x["rank"] for x in ranked(df, ("g",), F.desc("v"), "id").collect()}
        want = {x[2]: k for g in ("a", "b", None) for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])))}
        assert got == want
        dealt, parts = blocked(ranked(df, ("g",), "v", "id"), ("g",), 3, block=16)
        ahead = dealt.withColumn("next", F.lead("id", 3).over(Window.partitionBy(*parts).orderBy("rank"))).filter("_own")
        order = {g: [x[2] for x in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2]))] for g in ("a", "b", None)}
        assert {x["id"]: x["next"] for x in ahead.collect()} == {i: (ids[k + 3] if k + 3 < len(ids) else None) for ids in order.values() for k, i in enumerate(ids)}
        some = sequences.iqr_outliers(df, "v", ("g",), "id", factor=0.1)
        for g in ("a", "b", None):
            v = sorted(x[1] for x in rows if x[0] == g)
            q1, q3 = v[len(v) // 4], v[3 * len(v) // 4]
            out = {x[2] for x in rows if x[0] == g and (x[1] < q1 - 0.1 * (q3 - q1) or x[1] > q3 + 0.1 * (q3 - q1))}
            assert {x["id"] for x in some.filter(F.col("g").eqNullSafe(F.lit(g))).collect()} == out
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert ranked(df.filter("false"), ("g",), "v").collect() == []


def test_arithmetic_runs_equal_a_plain_version(spark):
    import random

    r = random.Random(2)
    rows = []
    for g in "ab":
        v = 100
        for i in range(150):
            v += r.choice([10, 10, 10, 10, -7, 30])
            rows.append((g, i, dt.date(2023, 1, 1) + dt.timedelta(days=3 * i + (200 if i > 70 else 0)), v))
    df = spark.createDataFrame(rows, "g string, id long, day date, v long")
    got = {(x["g"], x["first"], x["size"]) for x in sequences.arithmetic_runs(df, ("g",), "v", "day", "id").collect()}
    want = set()
    for g in "ab":
        s, found = [x for x in rows if x[0] == g], []
        for n in range(3, 10):
            for a in range(len(s) - n + 1):
                w = s[a : a + n]
                steps, mean = [y[3] - x[3] for x, y in zip(w, w[1:])], (w[-1][3] - w[0][3]) / (n - 1)
                if mean and all(abs(x - mean) <= 0.1 * abs(mean) for x in steps) and all((y[2] - x[2]).days <= 90 for x, y in zip(w, w[1:])):
                    found.append((a, n))
        covered = set()
        for a, n in sorted(found, key=lambda x: (-x[1], x[0])):
            if not covered & set(range(a, a + n)):
                covered |= set(range(a, a + n))
                want.add((g, a + 1, n))
    assert got == want and max(n for _, _, n in want) == 9


def test_split_rejections_equal_all_subsets(spark):
    """Every set of one to five other orders of the project near a rejected one, by trying all of them."""
    import itertools
    import random

    from tallyforge.operators.disguised import split_rejections

    r = random.Random(4)
    kinds = ["rejected", "Denied by owner", "declined", "approved", "approved", "approved", None]
    rows = [(k // 18, k, "change_order" if k % 9 else "invoice", r.choice(kinds), Decimal(r.choice([0, -50, 100, 5000, 4999, r.randrange(1, 5000), r.randrange(1, 5000), r.randrange(1, 5000)]))) for k in range(54)]
    rows += [(p, 100 + 10 * p + k, "change_order", kinds[k], Decimal(r.randrange(10_001, 16_000))) for p in range(3) for k in range(4)]
    docs = spark.createDataFrame(rows, "project_id int, doc_id long, doc_type string, status string, total decimal(15,2)")
    terms = spark.createDataFrame([(k, [f"t{k % 3}", f"t{k % 5}"]) for k in range(150)], "doc_id long, terms array<string>")
    for parts in (5, 2):
        want = {}
        for rejected in rows:
            if rejected[2] == "change_order" and rejected[3] in kinds[:3] and rejected[4] > 10_000:
                small = [x for x in rows if x[0] == rejected[0] and x[2] == "change_order" and 0 < x[4] < 5000 and x[1] != rejected[1]]
                for n in range(1, parts + 1):
                    for some in itertools.combinations(small, n):
                        total = sum(x[4] for x in some)
                        if abs(total - rejected[4]) * 1000 <= 50 * rejected[4]:
                            about = {f"t{x[1] % 3}" for x in some} | {f"t{x[1] % 5}" for x in some}
                            want[rejected[1], tuple(x[1] for x in some)] = (int(total * 100), round(0.8 + 0.05 * len(about & {f"t{rejected[1] % 3}", f"t{rejected[1] % 5}"}), 6))
        got = {(x["rejected_id"], tuple(x["parts"])): (x["sum_cents"], round(x["confidence"], 6)) for x in split_rejections(docs, parts=parts, terms=terms).collect()}
        assert got == want
        if parts == 5:
            assert {len(k[1]) for k in want} >= {3, 4, 5} and len(want) > 100
    assert split_rejections(docs.limit(0)).count() == 0


def _disguise(a, b):
    """The first rule that relates two amounts in dollars, tried as written, either way round."""
    u = {1: "rounded_1", 5: "rounded_5", 10: "rounded_10", 25: "rounded_25", 50: "rounded_50", 100: "rounded_100"}
    for unit, name in u.items():
        if abs(round(a / unit) * unit - b) < Decimal("0.01") or abs(a - round(b / unit) * unit) < Decimal("0.01"):
            return name
    if Decimal("1.05") <= max(a, b) / min(a, b) <= Decimal("1.15"):
        return "fee"
    for name, rates in (("tax", ("1.07", "1.08", "1.0925")), ("discount", ("0.9", "0.95", "0.925"))):
        if any(abs(x * Decimal(f) - y) < Decimal("0.5") for f in rates for x, y in ((a, b), (b, a))):
            return name
    return "near" if abs(a - b) / ((a + b) / 2) * 100 <= 5 and abs(a - b) <= 1000 else None


def test_fuzzy_amounts_equal_all_pairs(spark):
    import random

    from tallyforge.operators import disguised

    r = random.Random(9)
    base = [Decimal(r.randrange(100, 400_000)) / 100 for _ in range(40)]
    base += [Decimal("12.5"), Decimal("12"), Decimal("37.5"), Decimal("25"), Decimal("50"), Decimal("2.5"), Decimal("1000"), Decimal("1070"), Decimal("1070.50"), Decimal("1070.49"), Decimal("105"), Decimal("115"), Decimal("100"), Decimal("115.01"), Decimal("20000"), Decimal("21000"), Decimal("19000.01"), Decimal("0.01"), Decimal("0.5"), Decimal("1"), Decimal("1234"), Decimal("1235"), Decimal("1200"), Decimal("3"), Decimal("2.4"), Decimal("3.6"), Decimal("4"), Decimal("3.2")]
    rows = [(p, f"i{p}_{k}", r.choice(["invoice", "change_order", None]), v, r.choice(["pipe fitting", "Pipe bends and a long tail of words", "", None, "door"])) for p in (1, 2) for k, v in enumerate([*base, base[0], Decimal(0)])]
    items = spark.createDataFrame(rows, "project_id int, item_id string, doc_type string, amount decimal(15,2), description string")
    got = {(x["project_id"], x["a"], x["b"]): (x["rule"], x["differ"], x["alike"], round(x["confidence"], 6)) for x in disguised.fuzzy_items(items).collect()}
    want = {}
    for p in (1, 2):
        types, texts = {}, {}
        for row in rows:
            if row[0] == p:
                types.setdefault(row[3], set()).add(row[2] or "unknown")
                texts.setdefault(row[3], []).append(set((row[4] or "").lower().split()))
        amounts = sorted(v for v in types if v)
        for k, a in enumerate(amounts):
            for b in amounts[k + 1 :]:
                rule = _disguise(a, b)
                if rule:
                    alike = any(x and y and len(x & y) / min(len(x), len(y)) > 0.3 for x in texts[a] for y in texts[b])
                    differ = types[a] != types[b]
                    want[p, int(a * 100), int(b * 100)] = (rule, differ, alike, round(0.7 + 0.1 * differ + 0.15 * alike, 6))
    assert got == want
    assert {v[0] for v in want.values()} >= {"rounded_1", "rounded_5", "rounded_100", "fee", "tax", "discount", "near"} and {v[2] for v in want.values()} == {True, False}
    # Credits are compared with credits.
    signed = spark.createDataFrame([(1, -10_000), (1, -10_700), (1, 10_700)], "project_id int, cents long")
    assert [(x["a"], x["b"], x["rule"]) for x in disguised.disguised_pairs(signed).collect()] == [(-10_700, -10_000, "rounded_25")]


def test_amounts_near_zero_and_below(spark):
    """Bins of amounts lose no pair that the plain test has."""
    values = [Decimal(x) for x in ("0", "0", "-5", "-5", "0.01", "0.02", "100", "100.5", "101", "99.01")]
    d0 = dt.date(2023, 1, 1)
    items = spark.createDataFrame([(1, f"i{k}", k, "invoice", v, d0, "x") for k, v in enumerate(values)], "project_id int, item_id string, doc_id int, doc_type string, amount decimal(15,2), date_created date, description string")
    docs = spark.createDataFrame([(1, 100 + k, "change_order", "approved", v, d0 + dt.timedelta(days=5)) for k, v in enumerate(values)], "project_id int, doc_id int, doc_type string, status string, total decimal(15,2), date_created date")
    got = {x["item_id"]: x["n"] for x in sequences.amounts_before_approval(items, docs).collect()}
    want = {f"i{k}": sum(abs(v - o) * 1000 <= 10 * o for o in values) for k, v in enumerate(values)}
    assert got == {k: n for k, n in want.items() if n} and got["i0"] == 2


def test_description_groups_equal_all_pairs(spark):
    import random

    from tallyforge.operators.rules import description_groups

    r = random.Random(9)
    names = {" ".join(r.choice("abcdefghijkl") for _ in range(r.randrange(1, 6))) for _ in range(60)} | {"", " "}
    rows = [(r.choice(["x", "y", None]), n) for n in sorted(names) for _ in range(2)] + [("x", None)]
    got = {(x["code"], x["description"]): x["like"] for x in description_groups(spark.createDataFrame(rows, "code string, description string"), ("code",), 0.5).collect()}
    for code in ("x", "y", None):
        mine = sorted({n for c, n in rows if c == code and n is not None})
        like = {n: n for n in mine}
        for _ in range(60):
            for a in mine:
                for b in mine:
                    x, y = set(a.split()), set(b.split())
                    if x and y and len(x & y) / len(x | y) >= 0.5:
                        like[a] = like[b] = min(like[a], like[b])
        assert {n: v for (c, n), v in got.items() if c == code and n is not None} == like


def test_vector_ranks_in_blocks(spark):
    import random

    import numpy as np

    r = random.Random(3)
    rows = [(i, [round(r.uniform(-1, 1), 1) for _ in range(3)]) for i in range(90)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0]), (93, [1.0, None, 1.0]), (94, [1.0, 0.0, 0.0]), (95, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.filter("vec_id % 5 = 0 OR vec_id IN (90, 92)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = {i: np.array(x) for i, x in rows if x and None not in x}

    def cos(a, b):
        return 0.0 if not a.any() or not b.any() else round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), 10)

    for block in (4, 1000):
        got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in search.vector_ranks(v, q, 7, 0.1, block=block).collect()}
        want = {}
        for i in [i for i, x in rows if (i % 5 == 0 or i in (90, 92)) and i in whole]:
            best = sorted(((cos(whole[i], x), k) for k, x in whole.items() if len(x) == len(whole[i])), key=lambda p: (-p[0], p[1]))[:7]
            want |= {(i, n): (k, s) for n, (s, k) in enumerate(best, 1) if s >= 0.1}
        assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert search.vector_ranks(v.filter("false"), q).collect() == []


def test_structured_chunks(spark):
    parts = ["a" * 300, "b" * 300, "c" * 500, "d" * 100]
    long = ". ".join("word " * 30 for _ in range(15))
    table = spark.createDataFrame([(1, "\n\n".join(parts)), (2, long + "\n\n" + "tail " * 30), (3, None), (4, " \n \n ")], "doc_id long, text string")
    got = {}
    for x in search.structured_chunks(table).orderBy("chunk_index").collect():
        got.setdefault(x["doc_id"], []).append(x["chunk"])
    assert got[1] == ["a" * 300 + "\n\n" + "b" * 300, "b" * 200 + "\n\n" + "c" * 500 + "\n\n" + "d" * 100]
    assert set(got) == {1, 2} and all(len(c) <= 1202 for c in got[2]) and got[2][-1].endswith(("tail " * 30).rstrip() + " ")
    small = search.structured_chunks(table, contract=F.col("doc_id") == 2).filter("doc_id = 2").collect()
    assert max(x["chunk_length"] for x in small) <= 882


def test_projects_and_results(spark):
    from tallyforge.operators.registry import merged_results, projects, without_project

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "project_id int, x string")
    assert {x["project_id"]: x["rows"] for x in projects(without_project(df, 2)).collect()} == {1: 2, None: 1}
    got = merged_results({"p": df.filter("project_id = 1"), "q": df.filter("project_id = 2").withColumn("y", F.lit(3))}).collect()
    assert {(x["project_id"], x["x"], x["y"]) for x in got} == {("p", "a", None), ("p", "b", None), ("q", "c", 3)}
    with pytest.raises(ValueError):
        merged_results({})


def test_tables_without_headers(spark):
    text = "Concrete foundation work | 3 | $1,200.00\nSteel framing | 2 | $300.00\nSubtotal | | $1,500.00"
    rows = extract.table_rows(spark.createDataFrame([(1, text), (2, None), (3, "plain text")], "doc_id long, text string"))
    k = extract.key_columns(rows).collect()
    assert [(x["doc_id"], x["header"], x["description"], x["amount"], x["quantity"]) for x in k] == [(1, None, 0, 2, None)]
    assert sorted((x["description"], x["amount"]) for x in extract.table_items(rows).collect()) == [("Concrete foundation work", 1200.0), ("Steel framing", 300.0)]


def test_shared_folder_is_asked_for_on_a_cluster():
    from tallyforge.storage import shared_dir

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_amount_tables(spark):
    from tallyforge.operators import reports
    from tallyforge.plans.model import Model

    m = Model(spark, "/root/testdata/sf0.001")
    t = reports.amount_tables(m.items, m.documents, 50_000.0)
    n = m.items.filter("abs(amount - 50000) <= 500").count()
    assert n and t["matches"].count() == n and t["summary"].count() == 1 and set(t["anomalies"].columns) == {"kind", "subject", "confidence"}


def test_fuzzy_items_with_many_descriptions(spark):
    """An amount of more descriptions than travel with it: the one that is alike may be any of them."""
    from tallyforge.operators import disguised

    more = [f"word{k:02d} only" for k in range(3 * disguised.TEXTS)]
    rows = [(1, "invoice", Decimal(1000), t) for t in more] + [(1, "invoice", Decimal(1070), f"word{3 * disguised.TEXTS - 1:02d} door"), (1, "invoice", Decimal(-1000), "a"), (1, None, Decimal(-1100), "b"), (1, "invoice", Decimal(900), "nothing")]
    got = {(x["a"], x["b"]): (x["rule"], x["differ"], x["alike"]) for x in disguised.fuzzy_items(spark.createDataFrame(rows, "project_id int, doc_type string, amount decimal(15,2), description string")).collect()}
    assert got == {(100_000, 107_000): ("fee", False, True), (-110_000, -100_000): ("fee", True, False), (90_000, 100_000): ("fee", False, False)}


def test_disguised_pairs_deal_few_rows(spark):
    """Three rows of an amount go into the join, in which a pair comes once, so nothing is grouped after it."""
    from tallyforge.operators import disguised

    rows = spark.createDataFrame([(1, 100_000), (1, 107_000), (1, 15_000), (1, 19_960), (1, 20_000), (2, 100_000)], "project_id int, cents long")
    df = disguised.disguised_pairs(rows)
    assert sorted((x["a"], x["b"], x["rule"]) for x in df.collect()) == [(15_000, 20_000, "rounded_100"), (19_960, 20_000, "rounded_1"), (100_000, 107_000, "fee")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")  # all grouping is below the join


def test_drop_overlaps_in_a_long_chain(spark):
    """Spans of equal priority, each decided by the one before it, over many blocks; and random ones with spans of all sizes."""
    import random

    from tallyforge.operators.detectors import drop_overlaps

    r = random.Random(3)
    rows = [("a", k, 9, 0.95) for k in range(400)] + [(None, k, r.randrange(3, 10), r.choice([0.7, 0.8])) for k in range(300)] + [("c", k, 9, float(k)) for k in range(200)]
    for share in (0.5, 0.0):
        want = set()
        for g in ("a", None, "c"):
            taken = []
            for f, n in sorted(((f, n) for h, f, n, _ in rows if h == g), key=lambda x: next((-p, *x) for h, f, n, p in rows[x[0] + {"a": 0, None: 400, "c": 700}[g] :][:1])):
                common = [(min(f + n, a + b) - max(f, a), min(n, b)) for a, b in taken[-200:] + [t for t in taken if abs(t[0] - f) < 9]]
                if not any(c > 0 and c >= share * m for c, m in common):
                    taken.append((f, n))
            want |= {(g, *t) for t in taken}
        df = spark.createDataFrame(rows, "g string, first long, size long, p double")
        got = [(x["g"], x["first"], x["size"]) for x in drop_overlaps(df, ("g",), "first", "size", [F.desc("p")], share, block=100).collect()]
        assert len(got) == len(set(got)) and set(got) == want
