"""Detectors over documents, items and their relations: billing before approval, contradictions, restored scope, fees, mutual references."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents, near_bin, near_bins
from tallyforge.functions.json import number_at
from tallyforge.functions.texts import SUBSTITUTIONS, blended_similarity, plain, word_set
from tallyforge.operators.ordered import ranked
from tallyforge.shipping import ship
from tallyforge.storage import drop, stored

#: Fee words, words that make them suspicious, and authorised percentages (fixed values).
FEES = ("fee", "overhead", "markup", "profit", "premium", "surcharge", "admin", "supervision", "escalation")
MODIFIERS = ("additional", "supplemental", "extra", "special")
AUTHORISED = {"markup": 15.0, "general_conditions": 10.0, "bond": 1.5, "insurance": 2.0}


def premature_billing(items: DataFrame, documents: DataFrame, per_mille: int = 5) -> DataFrame:
    """Payment and invoice items within per_mille of an approved change order of the project that is dated after them; the nearest such order."""
    p = items.filter(F.col("doc_type").isin("payment_app", "invoice")).select("project_id", "item_id", F.col("date_created").alias("billed"), cents(F.col("amount")).alias("c"), near_bin(F.col("amount"), per_mille).alias("bin"))
    o = documents.filter("doc_type = 'change_order' AND status = 'approved'").select("project_id", F.col("doc_id").alias("order_id"), F.col("date_created").alias("approved"), cents(F.col("total")).alias("oc"), F.explode(near_bins(F.col("total"), per_mille)).alias("bin"))
    j = p.join(o, ["project_id", "bin"]).filter((F.col("approved") > F.col("billed")) & (F.abs(F.col("c") - F.col("oc")) * 1000 <= per_mille * F.col("oc")))
    return j.groupBy("project_id", "item_id").agg(F.min(F.struct(F.datediff("approved", "billed").alias("days"), "order_id")).alias("m")).select("project_id", "item_id", "m.order_id", "m.days")


def contradictory_approvals(documents: DataFrame, relationships: DataFrame) -> DataFrame:
    """Related documents of which one is approved and the other rejected."""
    s = documents.select("doc_id", "status")
    j = relationships.join(s.select(F.col("doc_id").alias("source_doc_id"), F.col("status").alias("source_status")), "source_doc_id").join(s.select(F.col("doc_id").alias("target_doc_id"), F.col("status").alias("target_status")), "target_doc_id")
    odd = ((F.col("source_status") == "approved") & (F.col("target_status") == "rejected")) | ((F.col("source_status") == "rejected") & (F.col("target_status") == "approved"))
    return j.filter(odd).select("source_doc_id", "target_doc_id", "relationship_type", "source_status", "target_status")


def missing_documentation(items: DataFrame, relationships: DataFrame, words: str = "new|change|extra|add|modif") -> DataFrame:
    """Payment items with a word of change, in documents that no change order is related to."""
    backed = relationships.filter("relationship_type = 'referenced_in'").select(F.col("target_doc_id").alias("doc_id")).distinct()
    return items.filter((F.col("doc_type") == "payment_app") & F.lower("description").rlike(words)).join(backed, "doc_id", "left_anti")


def rejected_scope(items: DataFrame, relationships: DataFrame, per_mille: int = 10) -> DataFrame:
    """Items of change orders with a rejection, and items of other documents of the project within per_mille of them; confidence 0.85."""
    r = relationships.filter("relationship_type = 'rejection'").select(F.col("source_doc_id").alias("doc_id")).distinct()
    a = items.join(r, "doc_id", "left_semi").select("project_id", F.col("doc_id").alias("order_id"), F.col("item_id").alias("rejected_id"), cents(F.col("amount")).alias("rc"), F.explode(near_bins(F.col("amount"), per_mille)).alias("bin"))
    b = items.select("project_id", F.col("doc_id").alias("other_doc"), F.col("item_id").alias("other_id"), cents(F.col("amount")).alias("c"), near_bin(F.col("amount"), per_mille).alias("bin"))
    return a.join(b, ["project_id", "bin"]).drop("bin").filter((F.col("order_id") != F.col("other_doc")) & (F.abs(F.col("c") - F.col("rc")) * 1000 <= per_mille * F.col("rc"))).withColumn("confidence", F.lit(0.85))


def scope_restoration(documents: DataFrame, items: DataFrame, least: float = 0.3) -> DataFrame:
    """Rejected change orders and the later change orders of the project that aren't rejected: likeness of their items' texts, and the share of the rejected total that they restore in all.

    Each order's text is its distinct descriptions in order. Pairs are those of one project that share a word, or have the two sides of a
    substitution; others can't reach `least`.
    """
    text = items.filter("doc_type = 'change_order'").groupBy("doc_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("description"))).alias("text"))
    o = documents.filter("doc_type = 'change_order'").join(text, "doc_id").select("project_id", "doc_id", "status", "date_created", cents(F.col("total")).alias("c"), "text")
    words = word_set(F.col("text"))
    side = lambda k: F.array_compact(F.array(*(F.when(plain(F.col("text")).contains(p[k]), F.lit(f"{p[0]}/{p[1]}")) for p in SUBSTITUTIONS)))
    token = lambda *columns: F.explode(F.array_distinct(F.concat(*columns))).alias("token")
    mark = lambda c, m: F.transform(c, lambda x: F.concat(F.lit(m), x))
    left = o.filter("status = 'rejected'").select("project_id", F.col("doc_id").alias("rejected_id"), F.col("date_created").alias("d0"), token(mark(words, "w"), mark(side(0), "0"), mark(side(1), "1")))
    right = o.filter("status != 'rejected'").select("project_id", "doc_id", "date_created", token(mark(words, "w"), mark(side(1), "0"), mark(side(0), "1")))
    near = left.join(right, ["project_id", "token"]).filter("date_created > d0").select("project_id", "rejected_id", "doc_id").distinct()
    r = o.select(F.col("doc_id").alias("rejected_id"), F.col("c").alias("rc"), F.col("text").alias("t0"))
    j = near.join(r, "rejected_id").join(o.select("doc_id", "c", "text"), "doc_id").withColumn("alike", blended_similarity(F.col("t0"), F.col("text"))).filter(F.col("alike") >= least)
    return j.groupBy("project_id", "rejected_id", "rc").agg(F.count(F.lit(1)).alias("orders"), F.max("alike").alias("alike"), F.sum("c").alias("restored")).withColumn("percent", F.col("restored") * 100.0 / F.col("rc"))


def hidden_fees(items: DataFrame, least: float = 100.0) -> DataFrame:
    """Items over `least` with a fee word; suspicious if a modifier stands with it."""
    fee, odd = r"\b(" + "|".join(FEES) + r")s?\b", r"\b(" + "|".join(MODIFIERS) + r")\b"
    low = F.lower("description")
    return items.filter((F.col("amount") > least) & low.rlike(fee)).withColumn("suspicious", low.rlike(odd))


def markup_changes(documents: DataFrame, items: DataFrame, points: float = 2.0) -> DataFrame:
    """Change orders whose mean markup over quantity * unit price differs from that of their project's first by over `points` percentage points."""
    cost = F.col("quantity") * cents(F.col("unit_price"))
    m = items.filter("doc_type = 'change_order' AND quantity > 0 AND unit_price > 0").groupBy("doc_id").agg((F.sum(cents(F.col("amount"))) * 100.0 / F.sum(cost) - 100).alias("markup"))
    w = Window.partitionBy("project_id").orderBy("date_created", "doc_id")
    d = documents.join(m, "doc_id").withColumn("first_markup", F.first("markup").over(w))
    return d.filter(F.abs(F.col("markup") - F.col("first_markup")) > points).select("project_id", "doc_id", "markup", "first_markup")


def mutual_references(relationships: DataFrame) -> DataFrame:
    """Pairs of documents that are related in both directions; confidence 0.65."""
    e = relationships.select("source_doc_id", "target_doc_id").distinct()
    back = e.select(F.col("target_doc_id").alias("source_doc_id"), F.col("source_doc_id").alias("target_doc_id"))
    return e.join(back, ["source_doc_id", "target_doc_id"], "left_semi").filter("source_doc_id < target_doc_id").withColumn("confidence", F.lit(0.65))


def sequential_chains(relationships: DataFrame, documents: DataFrame, kind: str = "change_order") -> DataFrame:
    """Three documents of a kind in sequence, with their totals' sum in cents."""
    t = documents.filter(F.col("doc_type") == kind).select("doc_id", cents(F.col("total")).alias("c"))
    s = relationships.filter("relationship_type = 'sequential'").select(F.col("source_doc_id").alias("x"), F.col("target_doc_id").alias("y"))
    j = s.select(F.col("x").alias("first"), F.col("y").alias("second")).join(s.select(F.col("x").alias("second"), F.col("y").alias("third")), "second")
    for name in ("first", "second", "third"):
        j = j.join(t.select(F.col("doc_id").alias(name), F.col("c").alias("c_" + name)), name)
    return j.select("first", "second", "third", (F.col("c_first") + F.col("c_second") + F.col("c_third")).alias("sum_cents"))


def metadata_math(documents: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """From meta_data (JSON) with line_items [{quantity, unit_price, total}], original_contract, change_orders, adjusted_contract: the checks that fail, with stated and expected values."""
    items = F.from_json(F.get_json_object("meta_data", "$.line_items"), "array<struct<quantity:double,unit_price:double,total:double>>")
    a = documents.select("doc_id", F.explode(items).alias("i")).select("doc_id", F.lit("line_item").alias("check"), (F.col("i.quantity") * F.col("i.unit_price")).alias("expected"), F.col("i.total").alias("stated"))
    at = lambda p: number_at(F.col("meta_data"), p)
    b = documents.select("doc_id", F.lit("adjusted_contract").alias("check"), (at("original_contract") + at("change_orders")).alias("expected"), at("adjusted_contract").alias("stated"))
    return a.unionByName(b).filter(F.abs(F.col("stated") - F.col("expected")) > tolerance)


def _greedy(first, size, rank, own, taken, share: float, longest: int):
    """Of one block's spans: 1 chosen, -1 dropped, 0 open, as it depends on spans of other blocks that are open. In order of rank, against what is decided around each."""
    state = [1 if t else 0 for t in taken]
    at: dict[int, list[int]] = {}  # by place: spans that are chosen, or open
    for i, t in enumerate(taken):
        if t:
            at.setdefault(first[i], []).append(i)
    for i in sorted((i for i, t in enumerate(taken) if not t), key=rank.__getitem__):
        f, n, now = first[i], size[i], 1 if own[i] else 0
        for place in range(f - longest + 1, f + n):
            for k in at.get(place, ()):
                common = min(f + n, place + size[k]) - max(f, place)
                if common > 0 and common >= share * min(n, size[k]):
                    if state[k] == 1:
                        now = -1
                        break
                    now = 0
            if now == -1:
                break
        state[i] = now
        if now != -1:
            at.setdefault(f, []).append(i)
    return state


def _shortened(spans: DataFrame, by: tuple[str, ...], first: str, size: str, priority: list[Column], share: float, longest: int, cell: int) -> DataFrame:
    """spans with _place, and with _gone where a span need not be looked at as it lies amid a run: spans at consecutive places, one at each, equally long, each before the next in priority.

    `longest` or more places from both ends of a run a span meets spans of the run only, and is chosen if the last one chosen lies `_step`
    places or more before it. So choices repeat every `_step` places, and a multiple of that many places may be taken out: the others are
    decided as before, with their places moved up. Runs are those within cells of `cell` places. `_from` is the first place taken out of
    a span's run, if any; the choice within `_step` places before it is repeated by _repeated().
    """
    steps = F.array(*(F.lit(next(d for d in range(1, n + 1) if d == n or n - d < share * n)) for n in range(1, longest + 1)))
    f, inside = F.col(first), [*by, "_cell"]
    d = spans.withColumn("_cell", F.floor(f / cell)).withColumn("_k", F.row_number().over(Window.partitionBy(*inside).orderBy(*priority, first, size)))
    w = Window.partitionBy(*inside).orderBy(first, "_k")
    on = (f == F.lag(first).over(w) + 1) & (F.col(size) == F.lag(size).over(w)) & (F.col("_k") > F.lag("_k").over(w))
    d = d.withColumn("_new", F.when(on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*inside, "_run").orderBy(first, "_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"_low": F.min(first).over(run), "_high": F.max(first).over(run), "_step": F.get(steps, F.col(size).cast("int") - 1)})
    # `longest` places at either end, and as many again beside what is taken out.
    out = F.greatest(F.floor((F.col("_high") - F.col("_low") + 1 - 4 * longest) / F.col("_step")), F.lit(0)) * F.col("_step")
    d = d.withColumns({"_from": F.when(out > 0, F.col("_low") + 2 * longest), "_out": out})
    d = d.withColumn("_gone", F.coalesce((f >= F.col("_from")) & (f < F.col("_from") + F.col("_out")), F.lit(False)))
    # A run's number grows with its places, so this is the order of places.
    passed = Window.partitionBy(*inside).orderBy("_run", first, "_k").rowsBetween(Window.unboundedPreceding, 0)
    d = stored(d.withColumn("_cut", F.sum(F.col("_gone").cast("long")).over(passed)).select(*spans.columns, "_cell", "_run", "_from", "_step", "_gone", "_cut"), "shortened")
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = d.groupBy(*inside).agg(F.sum(F.col("_gone").cast("long")).alias("_n"))
    cells = cells.select(*(F.col(c).alias(f"_{c}_") for c in inside), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return d.join(cells, _alike(inside, [f"_{c}_" for c in inside])).withColumn("_place", f - F.col("_before") - F.col("_cut")).drop("_before", *(f"_{c}_" for c in inside))


def _alike(a: list[str], b: list[str]) -> Column:
    """Whether columns a are those of b, nulls too."""
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(a, b, strict=True)), F.lit(True))


def _repeated(best: DataFrame, spans: DataFrame, by: tuple[str, ...], first: str) -> DataFrame:
    """Of spans (of _shortened) that are gone, those that repeat the choice in best before them."""
    keys = [*by, "_cell", "_run"]
    last = best.filter((F.col(first) < F.col("_from")) & (F.col(first) >= F.col("_from") - F.col("_step"))).select(*(F.col(c).alias(f"_{c}_") for c in keys), F.col(first).alias("_last"))
    return spans.filter("_gone").join(last, _alike(keys, [f"_{c}_" for c in keys])).filter(F.pmod(F.col(first) - F.col("_last"), F.col("_step")) == 0)


def drop_overlaps(spans: DataFrame, by: tuple[str, ...], first: str, size: str, priority: list[Column], share: float = 0.5, longest: int = 9, block: int = 1 << 17, cell: int = 1 << 13) -> DataFrame:
    """Greedy choice of spans (first, size, in places of a group) by priority: a span goes if a chosen one overlaps it by `share` of the smaller.

    Long runs of like spans, whose choices repeat, are shortened first (in cells of `cell` places). Then a task takes the spans of `block`
    places of a group in order of rank, and those within `longest` of its edges beside them, and decides all that doesn't depend on open
    spans of other blocks; the next round does so with what is decided. That gives what the sequential greedy gives, as ranks are
    distinct. A chain of spans, each decided by the one before, takes a round for each block that it crosses. Rounds are written to the
    shared folder, ids and places only.
    """
    short = _shortened(spans, by, first, size, priority, share, longest, cell)
    ranks = stored(ranked(short.filter("NOT _gone"), by, *priority, first, size, out="_rank"), "spans")
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    left = ranks.select(*named, F.col("_rank").cast("long").alias("r"), F.col("_place").cast("long").alias("f"), F.col(size).cast("long").alias("s"), F.lit(False).alias("taken"))
    schema = StructType([*(left.schema[k] for k in keys), *(StructField(c, LongType()) for c in ("r", "f", "s", "state"))])

    def run(t: pa.Table) -> pa.Table:
        f, s, r, own, taken = (t.column(c).to_pylist() for c in ("f", "s", "r", "own", "taken"))
        state = pa.array(_greedy(f, s, r, own, taken, share, longest), pa.int64())
        out = t.select([*keys, "r", "f", "s"]).append_column("state", state)
        return out.filter(pc.and_(pc.and_(t.column("own"), pc.invert(t.column("taken"))), pc.not_equal(state, -1)))

    ship(spans.sparkSession)
    at, inside = F.floor(F.col("f") / block), F.pmod("f", F.lit(block))
    old, chosen, edges = None, [], None
    while True:
        # A span near an edge also lies beside the next block.
        sides = F.array_compact(F.array(at, F.when(inside < longest, at - 1), F.when(inside >= block - longest, at + 1)))
        near = (inside < longest) | (inside >= block - longest)
        rows = left if edges is None else left.unionByName(edges)
        dealt = rows.withColumn("_block", F.explode(sides)).withColumn("own", F.col("_block") == at)
        new = stored(dealt.groupBy(*keys, "_block").applyInArrow(run, schema), "spans")
        if old is not None:
            drop(old)
        old, some = new, stored(new.filter("state = 1").select(*keys, "r", "f", "s"), "chosen")
        chosen.append(some)
        taken = some.filter(near).withColumn("taken", F.lit(True))
        edges = taken if edges is None else edges.unionByName(taken)
        left = new.filter("state = 0").select(*keys, "r", "f", "s", F.lit(False).alias("taken"))
        if not left.limit(1).count():
            break
    drop(old)
    best = reduce(DataFrame.unionByName, chosen).select(*keys, F.col("r").alias("_r"))
    best = ranks.join(best, _alike(list(by), keys) & (F.col("_r") == F.col("_rank"))).drop("_rank", "_r", *keys)
    return best.select(spans.columns).unionByName(_repeated(best, short, by, first).select(spans.columns))


def coordination(relationships: DataFrame, top: int = 3, longest: int = 3, rounds: int | None = None, part: str | None = None) -> DataFrame:
    """One row: documents that refer to others, mutual references, cycles of three to `longest`, confidence; and the `top` documents by PageRank (of `rounds` rounds if given), where at least three refer.

    Confidence min(0.95, 0.7 + 0.05 n) by the number of cycles if there are any, else min(0.85, 0.6 + 0.05 n) by that of mutual references.
    part names a column as in graph.document_edges. Edges are written once.
    """
    from tallyforge.operators import graph

    e = graph.document_edges(relationships, part=part)
    e = stored(e.select(*(c for c in ("part", "src", "dst") if c in e.columns)).distinct(), "edges")
    n = graph.cycles(e, max(longest, 2)).groupBy(F.size("path").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # A mutual reference is a cycle of two.
    found = n.agg(*(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0).cast("long")).alias(name) for name, of in (("mutual", F.col("size") == 2), ("cycles", F.col("size") > 2))))
    referring = e.agg(F.countDistinct("src").alias("referring"))
    best = graph.pagerank(e, rounds).orderBy(F.desc(F.round("rank", 12)), "id").limit(top).agg(F.array_sort(F.collect_list("id")).alias("central"))
    # One row each.
    one = referring.crossJoin(found).crossJoin(best)
    c = F.when(F.col("cycles") > 0, F.least(F.lit(0.95), 0.7 + 0.05 * F.col("cycles"))).when(F.col("mutual") > 0, F.least(F.lit(0.85), 0.6 + 0.05 * F.col("mutual"))).otherwise(0.0)
    return one.withColumns({"confidence": c, "central": F.when(F.col("referring") >= 3, F.col("central"))})


def network_patterns(documents: DataFrame, items: DataFrame, relationships: DataFrame, longest: int = 3) -> DataFrame:
    """kind, subject, confidence: sequential change orders (0.7), rejected scope that comes again (0.85), circular references (0.9)."""
    from tallyforge.operators import graph

    chain = sequential_chains(relationships, documents).select(F.lit("sequential_change_orders").alias("kind"), F.concat_ws(">", "first", "second", "third").alias("subject"), F.lit(0.7).alias("confidence"))
    scope = rejected_scope(items, relationships).groupBy("rejected_id").agg(F.max("confidence").alias("confidence")).select(F.lit("rejected_scope").alias("kind"), F.col("rejected_id").alias("subject"), "confidence")
    ring = graph.cycles(graph.document_edges(relationships), longest).select(F.lit("circular_reference").alias("kind"), F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("subject"), F.lit(0.9).alias("confidence"))
    return chain.unionByName(scope).unionByName(ring)
