"""Edges with a part: the same results as by rounds of joins, for small and large parts, without the rounds."""

import random

import pytest

from tallyforge.operators import detectors, graph, parts, structure

OPERATORS = {
    "centralities": lambda e: graph.centrality(e, rounds=6),
    "closeness": lambda e: graph.closeness(e),
    "closeness to a depth": lambda e: graph.closeness(e, 2),
    "betweenness": lambda e: graph.betweenness(e),
    "eigenvector": lambda e: graph.eigenvector(e, 6),
    "pagerank": lambda e: graph.pagerank(e, 6),
    "components": lambda e: graph.clusters(e),
    "strong": lambda e: structure.strong_components(e),
    "communities": lambda e: graph.communities(e),
    "cycles": lambda e: graph.cycles(e, 4),
}


def some_edges(spark):
    """Parts of few and of many edges, with copies, loops and a null part."""
    rng = random.Random(7)
    rows = [(None, 900, 901), (None, 901, 900), (1, 910, 910), (2, 920, 921), (2, 921, 922), (2, 920, 922)]
    for p in range(3, 12):
        for _ in range(rng.choice((4, 12, 25))):
            rows.append((p, 1000 * p + rng.randrange(8), 1000 * p + rng.randrange(8)))
    return spark.createDataFrame(rows + rows[::3], "part long, src long, dst long")


def plain(rows):
    return sorted(tuple(tuple(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("largest", [512, 10], ids=["small", "large"])
@pytest.mark.parametrize("name", OPERATORS)
def test_parts_equal_rounds(spark, monkeypatch, name, largest):
    monkeypatch.setattr(parts, "PART", largest)
    monkeypatch.setattr(parts, "CHUNK", 20)
    e = some_edges(spark).cache()
    got, want = OPERATORS[name](e), OPERATORS[name](e.select("src", "dst"))
    assert plain(got.select(*want.columns).collect()) == plain(want.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_parts_are_written_a_few_times_only(spark, monkeypatch, name):
    written = []
    for module in (graph, parts, structure):
        keep = module.stored
        monkeypatch.setattr(module, "stored", lambda df, what, keep=keep, **o: written.append(what) or keep(df, what, **o))
    OPERATORS[name](some_edges(spark)).collect()
    assert len(written) <= 3


def test_coordination_by_parts(spark):
    r = some_edges(spark).selectExpr("part AS project_id", "src AS source_doc_id", "dst AS target_doc_id", "'x' AS relationship_type", "1.0D AS confidence")
    assert plain(detectors.coordination(r, rounds=5, part="project_id").collect()) == plain(detectors.coordination(r, rounds=5).collect())
    mutual, cycles = detectors.mutual_references(r).count(), graph.cycles(graph.document_edges(r), 3).filter("size(path) = 3").count()
    got = detectors.coordination(r, rounds=5, part="project_id").first()
    assert (got["mutual"], got["cycles"]) == (mutual, cycles) and mutual and cycles


def test_no_edges(spark):
    none = spark.createDataFrame([], "part long, src long, dst long")
    for f in OPERATORS.values():
        assert f(none).count() == 0
