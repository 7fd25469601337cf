"""Graph structure, outlier models, best splits, running totals and stores against plain versions on small tables."""

import datetime as dt
import json
import math
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F


def _components(edges):
    """Strongly connected components by Tarjan's method: vertex to smallest id."""
    after, index, low, stack, out = defaultdict(list), {}, {}, [], {}
    for a, b in edges:
        after[a].append(b)

    def go(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in after[v]:
            if w not in index:
                go(w)
                low[v] = min(low[v], low[w])
            elif w not in out:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = stack[stack.index(v) :]
            del stack[stack.index(v) :]
            out.update({w: min(part) for w in part})

    for v in {x for e in edges for x in e}:
        if v not in index:
            go(v)
    return out


def test_strong_components(spark):
    from tallyforge.operators.structure import strong_components

    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(80)] + [(40 + i, 41 + i) for i in range(4)] + [(50, 50), (60, 61), (61, 60), (61, 60)]
    got = {x["id"]: (x["root"], x["size"]) for x in strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = _components(edges)
    assert got == {v: (c, list(want.values()).count(c)) for v, c in want.items()}
    assert max(n for _, n in got.values()) > 3
    assert strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_simple_cycles(spark):
    from tallyforge.operators.structure import simple_cycles

    edges = [(i, (i + 1) % 6) for i in range(6)] + [(0, 3), (3, 0), (7, 8), (8, 7), (8, 9), (9, 9)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(x["path"]) for x in simple_cycles(df).collect()} == {(0, 1, 2, 3, 4, 5), (0, 3, 4, 5), (0, 1, 2, 3), (0, 3), (7, 8)}
    with pytest.raises(RuntimeError, match="more than 4"):
        simple_cycles(df, 4)


def _louvain(edges):
    """The sequential method: vertices in order, best gain at once, until nothing moves; then the communities as vertices."""
    graph = defaultdict(lambda: defaultdict(float))
    for a, b in edges:
        graph[a][b] += 1
        graph[b][a] += 1
    whole, members = sum(sum(x.values()) for x in graph.values()), {v: {v} for v in graph}
    while True:
        k = {v: sum(graph[v].values()) for v in graph}
        label, total, moved, ever = {v: v for v in graph}, dict(k), True, False
        while moved:
            moved = False
            for v in sorted(graph):
                to = defaultdict(float)
                for w, x in graph[v].items():
                    to[label[w]] += x * (w != v)
                total[label[v]] -= k[v]
                best = max(sorted(to), key=lambda c: to[c] - k[v] * total[c] / whole)
                if to[best] - k[v] * total[best] / whole > to[label[v]] - k[v] * total[label[v]] / whole + 1e-12:
                    label[v], moved, ever = best, True, True
                total[label[v]] += k[v]
        if not ever:
            return {v: min(some) for some in members.values() for v in some}
        smaller, joined = defaultdict(lambda: defaultdict(float)), defaultdict(set)
        for a in graph:
            joined[label[a]] |= members[a]
            for b, x in graph[a].items():
                smaller[label[a]][label[b]] += x
        graph, members = smaller, joined


def test_communities_by_modularity(spark):
    from tallyforge.operators.structure import modularity, modularity_communities

    r = random.Random(3)
    ring = [(q * 5 + a, q * 5 + b) for q in range(6) for a in range(5) for b in range(a)] + [(q * 5, (q * 5 + 6) % 30) for q in range(6)]
    planted = [(a, b) for a in range(48) for b in range(a) if r.random() < (0.45 if a // 12 == b // 12 else 0.04)]
    for edges in (ring, planted):
        df = spark.createDataFrame(edges, "src long, dst long")
        got = {x["id"]: x["community"] for x in modularity_communities(df).collect()}
        plain = _louvain(edges)
        q = [modularity(df, spark.createDataFrame(list(x.items()), "id long, community long")) for x in (got, plain)]
        assert q[0] >= q[1] - 1e-9 and set(got) == set(plain)
        assert all(min(v for v in got if got[v] == c) == c for c in set(got.values()))
    assert got == {x["id"]: x["community"] for x in modularity_communities(df).collect()}  # the same each time
    assert modularity_communities(df.limit(0)).count() == 0


def test_communities_leave_out_what_is_at_rest(spark, monkeypatch):
    """Pairs apart from the rest settle at once; rounds go on with the edges of the one component that still moves."""
    from tallyforge.operators import structure

    sizes, write = [], structure.stored

    def counted(df, name, **options):
        out = write(df, name, **options)
        if name == "live":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(structure, "stored", counted)
    r = random.Random(3)
    big = [(a, b) for a in range(24) for b in range(a) if r.random() < (0.6 if a // 12 == b // 12 else 0.1)]
    edges = big + [(100 + 2 * k, 101 + 2 * k) for k in range(40)]
    got = {x["id"]: x["community"] for x in structure.modularity_communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[100 + 2 * k] == got[101 + 2 * k] == 100 + 2 * k for k in range(40)) and set(got) == {v for e in edges for v in e}
    assert sizes[0] == 2 * len(edges) and min(x for x in sizes[1:] if x) <= 2 * len(big)


def test_communities_of_whole_parts(spark, monkeypatch):
    """Parts apart from each other are taken whole, without rounds of joins; large ones by rounds, in the same graph."""
    from tallyforge.operators import parts, structure

    r, edges, plain = random.Random(5), [], []
    for part in range(12):
        at, n = 100 * part, 8 + 2 * part
        some = [(at + a, at + b) for a in range(n) for b in range(a) if r.random() < (0.7 if a // 6 == b // 6 else 0.06)]
        some += [(b, a) for a, b in some[::5]] + some[:3] + [(at, at)]
        edges += [(part, a, b) for a, b in some]
        plain += some
    edges += [(20, 2000, 2000), (21, 2100, 2101), (None, 2200, 2201), (21, None, 2102)]
    plain += [(2000, 2000), (2100, 2101), (2200, 2201)]
    df, want = spark.createDataFrame(edges, "part long, src long, dst long"), _louvain(plain)
    q = lambda x: structure.modularity(df.drop("part"), spark.createDataFrame(list(x.items()), "id long, community long"))
    # A loop is twice its weight in the plain version, too.
    written, keep = [], structure.stored
    monkeypatch.setattr(structure, "stored", lambda df, name, **o: written.append(name) or keep(df, name, **o))
    got = {x["id"]: x["community"] for x in structure.modularity_communities(df).collect()}
    assert written == [] and set(got) == set(want) and q(got) >= q(want) - 5e-3
    assert all(min(v for v in got if got[v] == c) == c for c in set(got.values())) and all(got[v] // 100 == v // 100 for v in got)
    assert (got[2000], got[2101], got[2201]) == (2000, 2100, 2200)
    # Names as text, other batches, and weights as repeated edges: the same divisions.
    monkeypatch.setattr(parts, "CHUNK", 32)
    again = df.filter("src IS NOT NULL").groupBy("part", "src", "dst").agg(F.count(F.lit(1)).alias("weight")).withColumns({c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 6, "0")) for c in ("src", "dst")})
    assert got == {int(x["id"][1:]): int(x["community"][1:]) for x in structure.modularity_communities(again).collect()}
    monkeypatch.setattr(parts, "LONG_PART", 70)
    mixed = {x["id"]: x["community"] for x in structure.modularity_communities(df).collect()}
    assert "live" in written and set(mixed) == set(want) and q(mixed) >= q(want) - 1e-2
    assert all(mixed[v] == got[v] for v in got if v < 300 or v >= 2000)
    assert structure.modularity_communities(df.limit(0)).count() == 0
    assert {x["id"]: x["community"] for x in structure.modularity_communities(df.withColumn("weight", F.lit(0.0))).collect()} == {v: v for v in got}


POINTS = [(k, float(random.Random(k).randrange(12)), float(random.Random(k + 500).randrange(9))) for k in range(150)]
POINTS += [(200 + k, 3.0, 3.0) for k in range(9)] + [(300, 60.0, 60.0), (301, -50.0, 4.0), (302, 60.0, 61.0)]
ODD = [(None, 1.0, 1.0), (400, None, 1.0), (401, float("nan"), 0.0), (402, float("inf"), 0.0)]


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double")


@pytest.mark.parametrize("k", [3, 20])
def test_local_outlier_factor_equals_all_pairs(spark, k):
    from tallyforge.operators.outliers import local_outlier_factor

    got = {x["id"]: (round(x["k_distance"], 6), round(x["density"], 6), round(x["factor"], 6)) for x in local_outlier_factor(_points(spark, POINTS + ODD), ["a", "b"], k).collect()}
    d = {p[0]: sorted((math.dist(p[1:], q[1:]), q[0]) for q in POINTS if q[0] != p[0]) for p in POINTS}
    kd = {i: x[k - 1][0] for i, x in d.items()}
    near = {i: [(s, j) for s, j in x if s <= kd[i]] for i, x in d.items()}
    density = {i: 1 / (sum(max(s, kd[j]) for s, j in x) / len(x) + 1e-10) for i, x in near.items()}
    assert set(got) == set(near)
    for i, x in near.items():
        assert got[i] == pytest.approx((kd[i], density[i], sum(density[j] for _, j in x) / len(x) / density[i]), rel=1e-5, abs=1e-5)
    if k == 20:
        assert max(got, key=lambda i: got[i][2]) in (300, 301, 302)


def test_few_points_have_all_as_neighbours(spark):
    from tallyforge.operators.outliers import local_outlier_factor

    one = local_outlier_factor(_points(spark, [(1, 0.0, 0.0)]), ["a", "b"], 5).collect()
    assert [(x["id"], x["factor"]) for x in one] == [(1, 1.0)]
    three = {x["id"]: x["k_distance"] for x in local_outlier_factor(_points(spark, [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 1.0)]), ["a", "b"], 5).collect()}
    assert three == pytest.approx({1: 5.0, 2: 5.0, 3: math.dist((3, 4), (0, 1))})
    assert local_outlier_factor(_points(spark, ODD), ["a", "b"]).count() == 0


@pytest.mark.parametrize(("eps", "least"), [(1.0, 5), (1.5, 12), (0.4, 3)])
def test_density_clusters_equal_all_pairs(spark, eps, least):
    from tallyforge.operators.outliers import density_clusters

    got = {x["id"]: (x["cluster"], x["core"]) for x in density_clusters(_points(spark, POINTS + ODD), ["a", "b"], eps, least).collect()}
    near = {p[0]: [q[0] for q in POINTS if math.dist(p[1:], q[1:]) <= eps] for p in POINTS}
    core = {i for i, x in near.items() if len(x) >= least}
    name = {i: i for i in core}
    for _ in range(len(core)):
        new = {i: min(name[j] for j in near[i] if j in core) for i in core}
        if new == name:
            break
        name = new
    want = {i: (name[i], True) if i in core else (min((name[j] for j in near[i] if j in core), default=None), False) for i in near}
    assert got == want and None in {c for c, _ in want.values()}


def test_isolation_trees_equal_a_plain_version(spark):
    import hashlib

    from tallyforge.operators.outliers import isolation_scores, isolation_trees

    def u(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32

    def mean(n):
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    trees, sample, seed = 7, 16, 42
    df = _points(spark, POINTS + ODD)
    nodes = isolation_trees(df, ["a", "b"], trees, sample, seed)
    got = {x["id"]: (x["path"], x["score"]) for x in isolation_scores(df, ["a", "b"], nodes, sample).collect()}
    paths = defaultdict(list)
    for t in range(trees):
        chosen = sorted(POINTS, key=lambda p: (u(seed, t, p[0]), p[0]))[:sample]

        def down(some, every, node, depth, t=t):
            spread = [i for i in (1, 2) if some and max(p[i] for p in some) > min(p[i] for p in some)]
            if len(some) <= 1 or not spread or depth == 4:
                for p in every:
                    paths[p[0]].append(depth + mean(len(some)))
                return
            i = spread[int(u(seed, "feature", t, node) * len(spread))]
            low, high = min(p[i] for p in some), max(p[i] for p in some)
            cut = high - u(seed, "cut", t, node) * (high - low)
            down([p for p in some if p[i] < cut], [p for p in every if p[i] < cut], 2 * node, depth + 1)
            down([p for p in some if p[i] >= cut], [p for p in every if p[i] >= cut], 2 * node + 1, depth + 1)

        down(chosen, POINTS, 1, 0)
    assert set(got) == {p[0] for p in POINTS}
    for i, x in paths.items():
        assert got[i] == pytest.approx((sum(x) / trees, 2 ** (-sum(x) / trees / mean(sample))))
    assert {x["tree"] for x in nodes.collect()} == set(range(trees))


def test_greedy_sums_equal_the_loop():
    import numpy as np

    from tallyforge.operators.splits import greedy_sums

    r = random.Random(6)
    for _ in range(300):
        values = np.array(sorted((r.choice([r.randrange(1, 50), 7, 1000]) for _ in range(r.randrange(1, 40))), reverse=True))
        most = r.randrange(1, 400)
        want = []
        for k in range(len(values)):
            total, n = int(values[k]), 1
            for x in values[k + 1 :]:
                if total + x <= most:
                    total, n = total + int(x), n + 1
            want.append((total, n))
        total, n = greedy_sums(values, most)
        assert list(zip(total.tolist(), n.tolist(), strict=True)) == want


def test_best_splits(spark):
    from tallyforge.operators.splits import best_splits

    day = lambda k: dt.date(2023, 1, 1) + dt.timedelta(days=k)
    rows = [
        (1, "big", Decimal(10000), day(0), "pump and pipe"), (1, "a", Decimal(6000), day(5), "pump and pipe"), (1, "b", Decimal(5200), day(20), None), (1, "c", Decimal(4100), day(89), "pipe and pump"),
        (1, "early", Decimal(4000), day(0), "x"), (1, "late", Decimal(4000), day(91), "x"), (1, "zero", Decimal(0), day(4), "x"), (2, "other", Decimal(4000), day(3), "x"), (2, "lone", Decimal(4300), day(0), "x"), (1, "undated", Decimal(9000), None, "x"),
    ]
    items = spark.createDataFrame(rows, "project_id int, item_id string, amount decimal(15,2), date_created date, description string")
    got = {x["big_id"]: x for x in best_splits(items).collect()}
    # 6000 + 4100 = 10100 is nearer than 5200 + 4100 = 9300; 6000 + 5200 would pass 11000.
    assert set(got) == {"big"} and (got["big"]["sum"], got["big"]["parts"], got["big"]["n"], got["big"]["alike"]) == (1_010_000, ["a", "c"], 2, 2)
    assert got["big"]["confidence"] == pytest.approx(0.7 + 0.15 * (1 - 0.1) + 0.02 + 0.04)
    assert {x["big_id"]: x["parts"] for x in best_splits(items, parts=1).collect()} == {"big": ["a", "c"], "lone": ["other"], "c": ["late"]}
    assert best_splits(items.limit(0)).count() == 0


def test_certificates_and_completion(spark):
    from pyspark.sql import functions as F

    from tallyforge.operators import splits

    said = lambda **x: json.dumps(x)
    rows = [
        (1, 10, 1, said(total_earned_less_retainage=1000.0, current_payment_due="1000", previous_certificates=5)), (1, 11, 2, said(previous_certificates=1000.005, total_earned_less_retainage=3000, current_payment_due=2000.5)),
        (1, 12, 3, said(previous_certificates=2400, total_earned_less_retainage=4000, current_payment_due=1600)), (1, 13, 4, None), (1, 14, 5, said(previous_certificates=7)), (2, 20, 1, "no json"),
    ]
    got = {(x["doc_id"], x["kind"]): round(x["confidence"], 6) for x in splits.certificate_mismatches(spark.createDataFrame(rows, "project_id int, doc_id int, number int, meta_data string")).collect()}
    assert got == {(12, "previous_certificate_mismatch"): 0.95}
    more = [(1, 1, 1, said(total_earned_less_retainage=1000)), (1, 2, 2, said(previous_certificates=950, total_earned_less_retainage=2000, current_payment_due=1000))]
    got = {x["kind"]: (x["expected"], round(x["confidence"], 6)) for x in splits.certificate_mismatches(spark.createDataFrame(more, "project_id int, doc_id int, number int, meta_data string")).collect()}
    assert got == {"previous_certificate_mismatch": (1000.0, 0.85), "payment_calculation_error": (1050.0, round(0.85 + 50 / 1050, 6))}
    texts = [(json.dumps({"percent_complete": x}),) for x in ("85%", "85", 0.85, "n/a", None)] + [("{}",), (None,)]
    assert [x[0] for x in spark.createDataFrame(texts, "m string").select(splits.percent_complete(F.col("m"))).collect()] == [0.85, 0.85, 0.85, None, None, None, None]
    r = random.Random(2)
    items = [(1, 100 + n * 10 + k, n, r.choice(["1", "2", None]), f"i{n}_{k}_{c}", r.choice([None, 0.0, 0.2, 0.5, 0.5, 0.9, 1.0])) for n in (1, 2, 3, 5, 9) for k in (0, 1) for c in range(3)]
    df = spark.createDataFrame(items, "project_id int, doc_id int, number int, item_number string, item_id string, share double")
    got = {x["item_id"]: (x["highest"], x["highest_doc"], round(x["confidence"], 6)) for x in splits.completion_regressions(df).collect()}
    want = {}
    for p, _, n, number, item, share in items:
        before = [(-x[5], x[2], x[1]) for x in items if number is not None and share is not None and x[5] is not None and (x[0], x[3]) == (p, number) and x[2] < n]
        if before and share < -min(before)[0] - 0.001:
            want[item] = (-min(before)[0], min(before)[2], round(min(0.95, 0.75 - min(before)[0] - share), 6))
    assert got == want and len(want) > 3


def test_store_writes_all_tables_or_none(spark, tmp_path):
    from tallyforge.sources.tables import Store

    store = Store(spark, str(tmp_path / "store"))
    docs, items = spark.range(3).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, text string")
    assert store.names() == [] and store.write("b1", {"documents": docs, "items": items})
    bad = docs.selectExpr("doc_id", "raise_error('broken') AS text")
    with pytest.raises(Exception, match="broken"):  # documents are staged by then, items fail
        store.write("b2", {"documents": docs, "items": bad})
    assert {k: v.count() for k, v in store.snapshot().items()} == {"documents": 3, "items": 2}
    assert store.write("b2", {"documents": docs, "items": items}) and not store.write("b2", {"documents": docs, "items": items})
    assert {k: v.count() for k, v in store.snapshot().items()} == {"documents": 6, "items": 4}
    with pytest.raises(ValueError, match="other columns"):
        store.write("b3", {"documents": items})
    assert len(store.vacuum()) == 2 and store.read("documents").count() == 6  # what the failed batch left
    assert store.write("b4", {"items": items.limit(1)}, replace=True) and store.read("items").count() == 1
    assert store.forget("items") and not store.forget("items") and store.names() == ["documents"]
    with pytest.raises(KeyError):
        store.read("items")


def test_stream_into_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyforge.sources.tables import Store, stream_tables

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id long, text string").coalesce(1).write.json(source)
    fails = [True]

    def split(batch):
        if fails and fails.pop():
            raise RuntimeError("in the middle")
        return {"documents": batch.select("doc_id"), "words": batch.select("doc_id", F.explode(F.split("text", " ")).alias("word"))}

    def run():
        stream = spark.readStream.schema("doc_id long, text string").json(source)
        stream_tables(stream, str(tmp_path / "store"), split, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    with pytest.raises(Exception, match="in the middle"):
        run()
    assert Store(spark, str(tmp_path / "store")).names() == []
    run()
    spark.createDataFrame([(3, "w")], "doc_id long, text string").coalesce(1).write.mode("append").json(source)
    run()
    run()  # nothing new
    assert {k: v.count() for k, v in Store(spark, str(tmp_path / "store")).snapshot().items()} == {"documents": 3, "words": 4}


def test_vector_catalogue(spark, tmp_path):
    from tallyforge.sources.tables import VectorCatalogue

    c = VectorCatalogue(spark, str(tmp_path / "vectors"))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert c.save("first", df, 2) == 2 and c.save("second", df, 1) == 1
    assert [(x["name"], x["dimensions"], x["vectors"]) for x in c.indices().collect()] == [("first", 2, 2), ("second", 1, 1)]
    assert sorted(x["vec_id"] for x in c.load("first").collect()) == [1, 3]
    assert c.clear("first") and c.load("first").count() == 0 and not c.clear("none")
    assert c.delete("first") and not c.delete("first") and [x["name"] for x in c.indices().collect()] == ["second"]
    with pytest.raises(ValueError, match="no name"):
        c.save("a/b", df, 2)


def test_compatible_text(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from tallyforge.functions.texts import compatible, prepared

    texts = ["ﬁne ﬂow", "１２３ ＡＢＣ", "été", "①②", "  plain\t\n text ", "", None, "x²", "ẛ̣"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(compatible(F.col("t")), prepared(F.col("t"), lower=True)).collect()
    assert [r[0] for r in rows] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [r[1] for r in rows] == [" ".join(unicodedata.normalize("NFKC", t or "").split()).lower() for t in texts]


def test_ranks_and_scores_settle(spark):
    import numpy as np

    from tallyforge.operators.graph import eigenvector, pagerank

    r = random.Random(8)
    edges = sorted({(r.randrange(15), r.randrange(15)) for _ in range(50)} | {(20, 1), (3, 21)})
    ids = sorted({x for e in edges for x in e})
    at = {v: k for k, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        m[at[b], at[a]] = 1
    out = m.sum(axis=0)
    walk = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / len(ids))
    rank = np.linalg.solve(np.eye(len(ids)) - 0.85 * walk, np.full(len(ids), 0.15 / len(ids)))
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {x["id"]: x["rank"] for x in pagerank(df, tolerance=1e-8).collect()}
    assert [got[v] for v in ids] == pytest.approx(rank, abs=1e-6)
    values, vectors = np.linalg.eig(m + np.eye(len(ids)))
    best = np.abs(vectors[:, np.argmax(values.real)].real)
    got = {x["id"]: x["score"] for x in eigenvector(df, tolerance=1e-8).collect()}
    assert [got[v] for v in ids] == pytest.approx(best / np.linalg.norm(best), abs=1e-5)
    with pytest.raises(RuntimeError, match="settle"):
        pagerank(df, most=2)
