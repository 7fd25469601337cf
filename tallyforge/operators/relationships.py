"""Relations between documents of a project, by rules over ordered pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import day_bin

RELATIONS = "source_doc_id bigint, target_doc_id bigint, relationship_type string, confidence double"


#: Pairs of document types that are related whatever their dates: from the first to the second.
TYPE_PAIRS = (("change_order", "correspondence"), ("change_order", "payment_app"), ("change_order", "invoice"), ("payment_app", "invoice"), ("correspondence", "invoice"), ("contract", "invoice"), ("invoice", "payment_app"))


def pair_rules(documents: DataFrame, days: int = 30) -> DataFrame:
    """project_id, source_doc_id, target_doc_id, relationship_type, confidence of documents of a project. Documents without a date are related with none.

    Change order and correspondence: rejection (0.95) or correspondence (0.85). Change order and payment: referenced_in (0.8), and
    rejected_reappearing (0.9) if it was rejected. Anything and invoice: related_invoice (0.85), and rejected_reappearing for a
    rejected change order; invoice and payment: referenced_in (0.85). Two payments, or change orders, with successive numbers, in order of
    dates: sequential (0.95). Two of another same type: revision (0.85) if only the later's file name says so. Within `days` days,
    otherwise: approval (0.9) for a change order and later correspondence, else parent_child (0.75). Of one day the smaller id is first.

    The rules of types relate all pairs of such documents of a project, so their result has that many rows by definition. The others are
    equality joins: on successive numbers, and on bins of dates.
    """
    cols = ("doc_id", "doc_type", "status", "date_created", "number", "file_name")
    dated = documents.filter("date_created IS NOT NULL").select("project_id", *cols)
    side = lambda p, *more: dated.select("project_id", *(F.col(c).alias(p + c) for c in cols), *more)
    before = (F.col("a_date_created") < F.col("b_date_created")) | ((F.col("a_date_created") == F.col("b_date_created")) & (F.col("a_doc_id") < F.col("b_doc_id")))
    relation = lambda kind, confidence: F.struct(kind.alias("relationship_type"), F.lit(confidence).alias("confidence"))
    of = lambda kind, confidence: relation(F.lit(kind), confidence)
    ends = ("project_id", F.col("a_doc_id").alias("source_doc_id"), F.col("b_doc_id").alias("target_doc_id"))

    role = lambda k, column: F.explode(F.array_compact(F.array(*(F.when(column == p[k], F.lit(">".join(p))) for p in TYPE_PAIRS)))).alias("pair")
    typed = side("a_", role(0, F.col("doc_type"))).join(side("b_", role(1, F.col("doc_type"))), ["project_id", "pair"]).filter(F.col("a_doc_id") != F.col("b_doc_id"))
    pair, refused = F.col("pair"), (F.col("a_doc_type") == "change_order") & (F.col("a_status") == "rejected")
    kinds = F.array_compact(F.array(
        F.when(pair == "change_order>correspondence", F.when(F.col("b_status") == "rejected", of("rejection", 0.95)).otherwise(of("correspondence", 0.85))),
        F.when(pair == "change_order>payment_app", of("referenced_in", 0.8)), F.when(pair == "invoice>payment_app", of("referenced_in", 0.85)),
        F.when(F.col("b_doc_type") == "invoice", of("related_invoice", 0.85)), F.when(refused & pair.isin("change_order>payment_app", "change_order>invoice"), of("rejected_reappearing", 0.9)),
    ))
    out = typed.select(*ends, F.explode(kinds).alias("r"))

    numbered = F.col("doc_type").isin("payment_app", "change_order")
    a = side("a_", F.col("doc_type").alias("t"), (F.col("number") + 1).alias("k")).filter(F.col("a_doc_type").isin("payment_app", "change_order"))
    b = side("b_", F.col("doc_type").alias("t"), F.col("number").alias("k")).filter(F.col("b_doc_type").isin("payment_app", "change_order"))
    out = out.unionByName(a.join(b, ["project_id", "t", "k"]).filter(before).select(*ends, of("sequential", 0.95).alias("r")))

    at = day_bin(F.col("date_created"), days + 1)
    named = F.coalesce(F.col("file_name").rlike("rev|version|update"), F.lit(False))
    near = side("a_", at.alias("bin"), numbered.alias("a_numbered"), named.alias("a_named")).join(side("b_", F.explode(F.array(at - 1, at)).alias("bin"), named.alias("b_named")), ["project_id", "bin"])
    near = near.filter(before & (F.datediff("b_date_created", "a_date_created") <= days))
    types = F.concat_ws(">", "a_doc_type", "b_doc_type")
    close = F.when(F.col("a_doc_type") == F.col("b_doc_type"), F.when(~F.col("a_numbered") & F.col("b_named") & ~F.col("a_named"), of("revision", 0.85)))
    close = close.when(types == "change_order>correspondence", of("approval", 0.9)).when(types != "correspondence>change_order", of("parent_child", 0.75))
    out = out.unionByName(near.select(*ends, close.alias("r")).filter("r IS NOT NULL"))
    return out.select("project_id", "source_doc_id", "target_doc_id", "r.*")


def two_hops(relationships: DataFrame, doc_id) -> DataFrame:
    """Documents within two relationships of a document, in either direction, with their least distance."""
    both = relationships.select(F.col("source_doc_id").alias("s"), F.col("target_doc_id").alias("t")).unionByName(relationships.select(F.col("target_doc_id").alias("s"), F.col("source_doc_id").alias("t"))).distinct()
    one = both.filter(F.col("s") == doc_id).select(F.col("t").alias("doc_id"), F.lit(1).alias("depth"))
    two = one.join(both, one["doc_id"] == both["s"]).select(F.col("t").alias("doc_id"), F.lit(2).alias("depth"))
    return one.unionByName(two).filter(F.col("doc_id") != doc_id).groupBy("doc_id").agg(F.min("depth").alias("depth"))


def chains(relationships: DataFrame, kinds: tuple[str, ...] = ("parent_child", "revision", "amendment", "sequential"), depth: int = 3) -> DataFrame:
    """From every document: the best next one (confidence, then id) up to `depth` steps, as an array of ids."""
    r = relationships.filter(F.col("relationship_type").isin(*kinds))
    best = r.groupBy(F.col("source_doc_id").alias("s")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("target_doc_id").alias("t"))).alias("b")).select("s", F.col("b.t").alias("t"))
    out = best.select(F.array("s", "t").alias("chain"))
    for _ in range(depth - 1):
        last = F.element_at("chain", -1)
        out = out.join(best, last == F.col("s"), "left").select(F.when(F.col("t").isNotNull() & ~F.array_contains("chain", F.col("t")), F.concat("chain", F.array("t"))).otherwise(F.col("chain")).alias("chain"))
    return out


def new_relations(found: DataFrame, known: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Those found that aren't known yet (source, target, type) and are confident enough."""
    return found.filter(F.col("confidence") >= min_confidence).join(known, ["source_doc_id", "target_doc_id", "relationship_type"], "left_anti")
