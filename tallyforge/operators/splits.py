"""Amounts that come back in parts, and payment applications whose running totals don't agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents
from tallyforge.functions.dates import day_bin
from tallyforge.functions.json import number_at
from tallyforge.functions.texts import jaccard, word_set
from tallyforge.operators.ordered import ranked
from tallyforge.operators.sequences import part_confidence
from tallyforge.shipping import ship


#: Rows of a project and span of days whose large items one task takes.
GROUP = 1 << 14


def greedy_sums(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start in values (whole numbers above 0, largest first): the sum of it and all later ones that still fit under `most`, and how many they are.

    From a place a run of neighbours fits, up to where prefix sums pass what is left; then all that are too large are skipped by a binary
    search. What is left falls below the next value each time, so a start takes few such jumps, and all starts take them at once.
    """
    n = len(values)
    upto = np.concatenate([[0], np.cumsum(values)])
    total, count, at = values.astype(np.int64).copy(), np.ones(n, np.int64), np.arange(1, n + 1)
    live = np.arange(n)
    while len(live):
        room = most - total[live]
        at[live] = np.maximum(at[live], np.searchsorted(-values, -room, "left"))
        live, room = live[at[live] < n], room[at[live] < n]
        end = np.searchsorted(upto, upto[at[live]] + room, "right") - 1
        total[live] += upto[end] - upto[at[live]]
        count[live] += end - at[live]
        at[live] = end
        live = live[end < n]
    return total, count


def _members(values: np.ndarray, start: int, most: int) -> list[int]:
    out, total = [start], int(values[start])
    for k in range(start + 1, len(values)):
        if total + values[k] <= most:
            out.append(k)
            total += int(values[k])
    return out


def best_splits(items: DataFrame, least: float = 1000.0, days: int = 90, per_mille: int = 100, parts: int = 2) -> DataFrame:
    """project_id, big_id, whole, sum, n, parts, alike, confidence: items over `least` and the set of later, smaller items of their project (at most `days` days on) that comes nearest to their amount.

    The sets are the greedy ones from every start: one candidate, then, of smaller ones, the largest that still fit within per_mille above
    the whole, and so on. Of those within per_mille the nearest wins, of equals the one with the largest first part (equal amounts in
    descending order of id); it counts with at least `parts` parts. alike: parts whose description shares 60 % of its words with the item's.

    Candidates of a project and span of days are sorted once and serve all its large items; a task holds those of one such group.
    """
    ship(items.sparkSession)
    rows = items.select("project_id", "item_id", F.datediff("date_created", F.lit("1970-01-01").cast("date")).alias("day"), cents(F.col("amount")).alias("c"), day_bin(F.col("date_created"), days).alias("bin")).filter("day IS NOT NULL AND c > 0")
    # Groups of a project and span of days; the large items of one with very many rows are dealt over several copies of its candidates.
    sizes = rows.groupBy("project_id", "bin").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    big = rows.filter(F.col("c") > round(least * 100)).join(sizes, ["project_id", "bin"]).select("project_id", "bin", F.pmod(F.xxhash64("item_id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("large"), "item_id", "day", "c")
    small = rows.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") - 1))).join(sizes, ["project_id", "bin"])
    small = small.select("project_id", "bin", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("large"), "item_id", "day", "c")
    project, item = (rows.schema[c].dataType.simpleString() for c in ("project_id", "item_id"))
    keys = ("project_id", "bin", "salt")

    def solved(group: list[tuple]) -> list[tuple]:
        """group: rows of one key, candidates first, largest first."""
        some = [r for r in group if not r[3]]
        ids, day, value = [r[4] for r in some], np.array([r[5] for r in some], np.int64), np.array([r[6] for r in some], np.int64)
        out = []
        for p, _, _, _, key, d, whole in group[len(some) :]:
            fits = np.flatnonzero((day > d) & (day <= d + days) & (value < whole))
            if not len(fits):
                continue
            most = whole * (1000 + per_mille) // 1000
            total, count = greedy_sums(value[fits], most)
            off = np.abs(total - whole)
            best = int(np.argmin(off))
            if off[best] * 1000 <= per_mille * whole and count[best] >= parts:
                out.append((p, key, whole, int(total[best]), int(count[best]), [ids[fits[k]] for k in _members(value[fits], best, most)]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if group[-1][3]:
                        found += solved(group)
                    group = []
                group.append(row)
            yield from _batches(found, batch.schema)
        if group and group[-1][3]:
            yield from _batches(solved(group), batch.schema)

    def _batches(found: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if found:
            kinds = (schema.field("project_id").type, schema.field("item_id").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(schema.field("item_id").type))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["project_id", "big_id", "whole", "sum", "n", "parts"])

    dealt = small.unionByName(big).repartition(*keys).sortWithinPartitions(*keys, "large", F.desc("c"), F.desc("item_id"))
    found = dealt.mapInArrow(run, f"project_id {project}, big_id {item}, whole long, sum long, n long, parts array<{item}>")
    text = items.select("item_id", word_set(F.col("description")).alias("w")).dropDuplicates(["item_id"])
    each = found.select("big_id", F.explode("parts").alias("item_id")).join(text, "item_id").select("big_id", F.col("w").alias("theirs"))
    alike = each.join(text.select(F.col("item_id").alias("big_id"), "w"), "big_id").filter(jaccard(F.col("w"), F.col("theirs")) >= 0.6).groupBy("big_id").agg(F.count(F.lit(1)).alias("alike"))
    out = found.join(alike, "big_id", "left").withColumn("alike", F.coalesce("alike", F.lit(0)))
    return out.withColumn("confidence", part_confidence(F.col("sum") - F.col("whole"), F.col("whole"), F.col("n"), F.col("alike")))


#: Figures of a payment application in its meta_data.
STATED = ("previous_certificates", "total_earned_less_retainage", "current_payment_due")


def percent_complete(data: Column, parsed: Column | None = None) -> Column:
    """A share from 0 to 1 of meta_data's percent_complete: text in percent, with or without its sign, is divided by 100; a number stands as it is. parsed: the same data, where it is parsed already."""
    text = F.try_variant_get(F.try_parse_json(data) if parsed is None else parsed, "$.percent_complete", "string")
    quoted = data.rlike(r'"percent_complete"\s*:\s*"') & F.get_json_object(data, "$.percent_complete").isNotNull()
    return F.when(quoted, F.regexp_replace(text, "%+$", "").try_cast("double") / 100).otherwise(text.try_cast("double"))


def certificate_mismatches(applications: DataFrame, tolerance: float = 0.01, share: float = 0.001) -> DataFrame:
    """project_id, doc_id, kind, stated, expected, confidence of payment applications (project_id, doc_id, number, meta_data in JSON) after a project's first, in order of number.

    previous_certificate_mismatch: previous_certificates against what the application before had earned; 0.80 + the difference's share of
    the larger. payment_calculation_error: current_payment_due against earned less previous certificates; 0.85 + share. At most 0.95;
    differences up to `tolerance` or a `share` of the larger are none; a figure that is missing is not compared.
    """
    a = applications.select("project_id", "doc_id", "number", *(number_at(F.col("meta_data"), c).alias(c) for c in STATED))
    w = Window.partitionBy("project_id").orderBy("number", "doc_id")
    a = a.withColumns({"place": F.row_number().over(w), "earned_before": F.lag("total_earned_less_retainage").over(w)}).filter("place > 1")
    kinds = (("previous_certificate_mismatch", F.col("previous_certificates"), F.col("earned_before"), 0.80), ("payment_calculation_error", F.col("current_payment_due"), F.col("total_earned_less_retainage") - F.col("previous_certificates"), 0.85))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), s.alias("stated"), e.alias("expected"), F.lit(base).alias("base")) for k, s, e, base in kinds)))
    d = a.select("project_id", "doc_id", each.alias("x")).select("project_id", "doc_id", "x.*").withColumn("off", F.abs(F.col("stated") - F.col("expected")))
    d = d.withColumn("share", F.try_divide(F.col("off"), F.greatest("stated", "expected"))).filter((F.col("off") > tolerance) & (F.col("share") > share))
    return d.select("project_id", "doc_id", "kind", "stated", "expected", F.least(F.lit(0.95), F.col("base") + F.col("share")).alias("confidence"))


def completion_regressions(items: DataFrame, points: float = 0.001) -> DataFrame:
    """items' columns with highest, highest_doc and confidence: items of payment applications (project_id, doc_id, number, item_number, share) that are less complete than in any earlier application of the project.

    highest is the largest share of the same item number in an application of a smaller number (of equals that of the smallest number,
    then document), confidence 0.75 + the decrease, at most 0.95; decreases up to `points` are none.

    Highest so far is a running maximum per project and item number over ranges of rows in order: each range's own, and what earlier
    ranges have, one row for each range and item number, so an item number of very many applications is no large group.
    """
    rows = items.filter("share IS NOT NULL AND number IS NOT NULL AND item_number IS NOT NULL")
    # One row for each application and item number, with the document that has its largest share.
    each = rows.groupBy("project_id", "item_number", "number").agg(F.min(F.struct((-F.col("share")).alias("s"), "doc_id")).alias("b"))
    each = each.select("project_id", "item_number", "number", (-F.col("b.s")).alias("most"), F.col("b.doc_id").alias("most_doc"))
    keys = ("project_id", "item_number")
    placed = ranked(each, keys, "number").withColumn("range", F.floor(F.col("rank") / 4096))
    best = lambda: F.min(F.struct((-F.col("most")).alias("s"), F.col("number").alias("n"), F.col("most_doc").alias("d")))
    own = best().over(Window.partitionBy(*keys, "range").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    carried = placed.groupBy(*keys, "range").agg(best().alias("b"))
    carried = carried.select(*keys, "range", F.min("b").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = placed.withColumn("own", own).join(carried, [*keys, "range"]).select(*keys, "number", F.least("own", "carried").alias("b")).filter("b IS NOT NULL")
    j = rows.join(before, [*keys, "number"]).select(*items.columns, (-F.col("b.s")).alias("highest"), F.col("b.d").alias("highest_doc"))
    j = j.filter(F.col("share") < F.col("highest") - points)
    return j.withColumn("confidence", F.least(F.lit(0.95), 0.75 + F.col("highest") - F.col("share")))
