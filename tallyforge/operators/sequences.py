"""Order: runs, gaps, clusters, outliers, splits and combinations over time. Every order ends with an id, so results are the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.amounts import cents, near_bin, near_bins
from tallyforge.functions.dates import day_bin
from tallyforge.functions.texts import jaccard, word_set
from tallyforge.operators.ordered import blocked, ranked


def with_groups(rows: DataFrame, by: tuple[str, ...], **figures: Column) -> DataFrame:
    """rows with figures of their group: aggregated before the shuffle and joined again, so no task holds a group. Null groups are a group."""
    g = rows.groupBy(*by).agg(*(c.alias(name) for name, c in figures.items())).withColumnsRenamed({c: f"_{c}_" for c in by})
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return rows.join(g, on).drop(*(f"_{c}_" for c in by))


def zscore_outliers(rows: DataFrame, value: str, by: tuple[str, ...], z: float = 2.5, least: int = 5) -> DataFrame:
    """Rows whose value is over z population deviations from their group's mean, in groups of `least` rows whose deviation is at least 1 % of the mean; confidence 0.7 and up."""
    s = with_groups(rows, by, n=F.count(value), mean=F.avg(value), std=F.stddev_pop(value))
    s = s.filter((F.col("n") >= least) & (F.col("std") > 0) & (F.col("std") >= 0.01 * F.abs("mean"))).withColumn("z", (F.col(value) - F.col("mean")) / F.col("std"))
    return s.filter(F.abs("z") > z).withColumn("confidence", F.least(F.lit(0.95), 0.7 + 0.1 * (F.abs("z") - z)))


def iqr_outliers(rows: DataFrame, value: str, by: tuple[str, ...], order: str, factor: float = 1.5, least: int = 5) -> DataFrame:
    """Rows beyond the quartiles by factor times their distance. Quartiles are the values at 0-based places n // 4 and 3 n // 4; no interpolation."""
    some = rows.filter(F.col(value).isNotNull())
    # Places are those of values alone: which of equal ones is at a quartile does not matter, and rows stay where they are.
    s = with_groups(ranked(some.select(*by, value), by, value, out="_k"), by, n=F.count(F.lit(1)))
    at = lambda place: F.max(F.when(F.col("_k") == place, F.col(value)))
    g = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at(F.floor(F.col("n") / 4)).alias("q1"), at(F.floor(F.col("n") * 3 / 4)).alias("q3")).withColumnsRenamed({c: f"_{c}_" for c in by})
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    s = some.join(g, on).drop(*(f"_{c}_" for c in by)).withColumn("iqr", F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - factor * F.col("iqr"), F.col("q3") + factor * F.col("iqr")
    return s.filter((F.col("n") >= least) & (F.col("iqr") > 0) & ((F.col(value) < low) | (F.col(value) > high)))


def monotone_runs(rows: DataFrame, by: tuple[str, ...], value: str, date: str, order: str, increasing: bool = True, gap: int = 90, least: int = 3) -> DataFrame:
    """Maximal strictly rising (or falling) runs of at least `least` rows of a group in order of date, with at most `gap` days between neighbours.

    Confidence: 0.5, up to 0.3 for length, up to 0.15 each for even steps and even days; at most 0.95.
    """
    w = Window.partitionBy(*by).orderBy(date, order)
    before, day = F.lag(value).over(w), F.lag(date).over(w)
    on = ((F.col(value) > before) if increasing else (F.col(value) < before)) & (F.datediff(date, day) <= gap)
    r = rows.withColumns({"_step": F.when(on, F.col(value) - before), "_days": F.when(on, F.datediff(date, day)), "_new": F.when(on, 0).otherwise(1)})
    r = r.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    even = lambda c: F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.var_pop(c), F.avg(c) * F.avg(c)), F.lit(0.0)))
    g = r.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("start"), F.max(date).alias("end"), F.min(value).alias("low"), F.max(value).alias("high"), even(F.col("_step").cast("double")).alias("even_steps"), even(F.col("_days").cast("double")).alias("even_days"))
    c = F.least(F.lit(0.95), 0.5 + 0.3 * F.least(F.lit(1.0), (F.col("n") - 2) / 8) + 0.15 * F.col("even_steps") + 0.15 * F.col("even_days"))
    return g.filter(F.col("n") >= least).withColumn("confidence", c)


def progressions(rows: DataFrame, by: tuple[str, ...], value: str, date: str, order: str, increasing: bool = True, least: int = 3) -> DataFrame:
    """Maximal runs of at least `least` rows that never fall (or never rise): n, start, end, first and last value, percent of change; confidence 0.7, up to 0.1 for length and 0.15 for change."""
    w = Window.partitionBy(*by).orderBy(date, order)
    on = F.col(value) >= F.lag(value).over(w) if increasing else F.col(value) <= F.lag(value).over(w)
    r = rows.filter(F.col(value).isNotNull()).withColumn("_new", F.when(on, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.min(value), F.max(value)
    g = r.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("start"), F.max(date).alias("end"), (low if increasing else high).alias("first_value"), (high if increasing else low).alias("last_value")).filter(F.col("n") >= least)
    g = g.withColumn("percent", F.when(F.col("first_value") > 0, F.abs(F.col("last_value") - F.col("first_value")).cast("double") / F.col("first_value").cast("double") * 100).otherwise(0.0))
    return g.withColumn("confidence", F.least(F.lit(0.95), 0.7 + F.least(F.col("n") / 10, F.lit(0.1)) + F.least(F.col("percent") / 100, F.lit(0.15))))


def sequence_patterns(documents: DataFrame) -> DataFrame:
    """project_id, pattern, n: rising and falling runs of totals, totals that alternate, and days of the month that come again."""
    run = lambda up, name: progressions(documents, ("project_id",), "total", "date_created", "doc_id", up).select("project_id", F.lit(name).alias("pattern"), "n")
    out = run(True, "rising").unionByName(run(False, "falling"))
    out = out.unionByName(alternating(documents).select("project_id", F.lit("alternating").alias("pattern"), "n"))
    return out.unionByName(same_day_of_month(documents).select("project_id", F.lit("day of month").alias("pattern"), "n"))


def key_documents(documents: DataFrame, main: Column | None = None, gap: int = 30) -> DataFrame:
    """key_events() of documents without changes of status, and the main ones (a condition)."""
    events = key_events(documents, gap).filter("event != 'status change'")
    return events if main is None else events.unionByName(documents.filter(main).select("project_id", "doc_id", "date_created", F.lit("main").alias("event")))


def arithmetic_windows(rows: DataFrame, by: tuple[str, ...], value: str, date: str, order: str, sizes: range = range(3, 10), gap: int = 90, off: float = 0.1) -> DataFrame:
    """Windows of 3 to 9 consecutive rows whose steps are all within `off` of their mean step and at most `gap` days apart: group, first place (from 1), size, mean_step, confidence.

    All windows; `first` and `size` say which overlap. Confidence as for runs, and 0.1 for the even step; at most 0.95.
    """
    ranks = ranked(rows.select(*by, F.col(value).alias("_v"), F.col(date).alias("_t"), F.col(order).alias("_o")), by, "_t", "_o", carry=(*by, "_v", "_t"))
    dealt, parts = blocked(ranks, by, max(sizes))
    w = Window.partitionBy(*parts).orderBy("rank")
    r = dealt.withColumns({f"{c}{k}": F.lead(c, k).over(w) for k in range(1, max(sizes)) for c in ("_v", "_t")}).withColumnsRenamed({"_v": "_v0", "_t": "_t0"}).filter("_own")
    steps = lambda f: F.array(*(f(k, k + 1) for k in range(max(sizes) - 1)))
    r = r.select(*by, (F.col("rank") + 1).alias("first"), steps(lambda j, k: F.col(f"_v{k}") - F.col(f"_v{j}")).alias("_d"), steps(lambda j, k: F.datediff(f"_t{k}", f"_t{j}")).alias("_g"))
    if min(sizes) > 2 and 0 <= off < 1:
        # Steps that are all within `off` of their mean have its sign, and their sizes are this near each other; most places end with the first two.
        x, y = F.col("_d")[0].cast("double"), F.col("_d")[1].cast("double")
        r = r.filter((x != 0) & (F.signum(x) == F.signum(y)) & (F.greatest(F.abs(x), F.abs(y)) * (1 - off) <= F.least(F.abs(x), F.abs(y)) * (1 + off) * (1 + 1e-9)))
    r = r.withColumn("size", F.explode(F.array(*(F.lit(n) for n in sizes))))
    r = r.withColumns({"_d": F.transform(F.slice("_d", F.lit(1), F.col("size") - 1), lambda x: x.cast("double")), "_g": F.slice("_g", F.lit(1), F.col("size") - 1)})
    # A missing step makes the mean null; days that are missing are passed over.
    total = lambda c, of=lambda x: x: F.aggregate(c, F.lit(0.0), lambda s, x: s + of(x))
    r = r.withColumn("mean_step", total("_d") / F.size("_d"))
    mean, bound = F.col("mean_step"), off * F.abs("mean_step")
    r = r.filter((mean != 0) & (F.array_max("_d") - mean <= bound) & (mean - F.array_min("_d") <= bound) & (F.array_max("_g") <= gap))
    r = r.withColumn("_g", F.transform(F.array_compact("_g"), lambda x: x.cast("double"))).withColumn("_days", total("_g") / F.size("_g"))
    even = lambda c, m: F.when(m > 0, F.greatest(F.lit(0.0), 0.15 * (1 - F.least(F.lit(1.0), 5 * total(c, lambda x: (x - m) * (x - m)) / F.size(c) / (m * m))))).otherwise(0.0)
    c = 0.5 + 0.3 * F.least(F.lit(1.0), (F.col("size") - 2) / 8) + even("_d", mean) + even("_g", F.col("_days"))
    return r.select(*by, "first", "size", "mean_step", F.least(F.lit(0.95), F.least(F.lit(0.95), c) + 0.1).alias("confidence"))


def arithmetic_runs(rows: DataFrame, by: tuple[str, ...], value: str, date: str, order: str, **windows) -> DataFrame:
    """Of arithmetic_windows those that remain if the longest, then the earliest, are taken first and none overlaps a taken one."""
    from tallyforge.operators.detectors import drop_overlaps

    return drop_overlaps(arithmetic_windows(rows, by, value, date, order, **windows), by, "first", "size", [F.desc("size"), F.col("first")], share=0.0)


def gaps(documents: DataFrame, by: tuple[str, ...] = ("project_id",), days: int = 60) -> DataFrame:
    """Gaps of over `days` days between consecutive documents of a group, with the group's statistics. unusual: z over 2, or over three times the mean; confidence 0.7 and up."""
    w, g = Window.partitionBy(*by).orderBy("date_created", "doc_id"), Window.partitionBy(*by)
    d = documents.withColumns({"previous": F.lag("date_created").over(w)}).withColumn("gap", F.datediff("date_created", "previous")).filter("gap IS NOT NULL")
    d = d.withColumns({"mean": F.avg("gap").over(g), "std": F.stddev_pop("gap").over(g)}).withColumn("z", F.coalesce(F.try_divide(F.col("gap") - F.col("mean"), F.col("std")), F.lit(0.0)))
    d = d.filter(F.col("gap") > days).withColumn("unusual", (F.col("z") > 2) | (F.col("gap") > 3 * F.col("mean")))
    return d.withColumn("confidence", 0.7 + F.least(F.col("z") / 5, F.lit(0.25)))


def _cluster_ends(documents: DataFrame, by: tuple[str, ...], sizes: range) -> DataFrame:
    """by, doc_id, date_created and rank, the document's 0-based place in its group, with the dates of the documents that end a run of each size from it (_e3 to _e9)."""
    rows, parts = blocked(ranked(documents.select(*by, "doc_id", "date_created"), by, "date_created", "doc_id"), by, max(sizes) - 1)
    w = Window.partitionBy(*parts).orderBy("rank")
    return rows.withColumns({f"_e{n}": F.lead("date_created", n - 1).over(w) for n in sizes}).filter("_own")


def _density(size: Column, span: Column) -> tuple[Column, Column]:
    """A cluster's density and confidence."""
    density = size / (span + 1)
    return density, 0.7 + F.least(0.2 * (density - 1), F.lit(0.25))


def event_clusters(documents: DataFrame, by: tuple[str, ...] = ("party",), sizes: range = range(3, 10)) -> DataFrame:
    """Runs of 3 to 9 consecutive documents of a group that span at most 2 (size - 1) days; density size / (span + 1); confidence 0.7 and up."""
    base = _cluster_ends(documents, by, sizes)
    d = base.select(*by, "doc_id", F.col("date_created").alias("start"), F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.col(f"_e{n}").alias("end")) for n in sizes))).alias("c")).select(*by, "doc_id", "start", "c.*")
    d = d.withColumn("span", F.datediff("end", "start")).filter(F.col("span") <= 2 * (F.col("size") - 1))
    density, confidence = _density(F.col("size"), F.col("span"))
    return d.withColumns({"density": density, "confidence": confidence})


def best_event_clusters(documents: DataFrame, by: tuple[str, ...] = ("party",), sizes: range = range(3, 10)) -> DataFrame:
    """best_clusters() of event_clusters(), with first, the 0-based place of its document in the group; chosen in the document's row."""
    d = _cluster_ends(documents, by, sizes).withColumns({f"_s{n}": F.datediff(f"_e{n}", "date_created") for n in sizes})
    d = d.withColumns({f"_c{n}": F.when(F.col(f"_s{n}") <= 2 * (n - 1), _density(F.lit(n), F.col(f"_s{n}"))[1]) for n in sizes})
    d = d.withColumn("_top", F.array_max(F.array(*(f"_c{n}" for n in sizes)))).filter("_top IS NOT NULL")
    d = d.withColumn("size", F.coalesce(*(F.when(F.col(f"_c{n}") == F.col("_top"), n) for n in reversed(sizes))))
    at = lambda c: F.coalesce(*(F.when(F.col("size") == n, F.col(f"{c}{n}")) for n in sizes))
    d = d.select(*by, "doc_id", F.col("rank").alias("first"), F.col("date_created").alias("start"), "size", at("_e").alias("end"), at("_s").alias("span"), F.col("_top").alias("confidence"))
    return d.select(*by, "doc_id", "first", "start", "size", "end", "span", _density(F.col("size"), F.col("span"))[0].alias("density"), "confidence")


def best_clusters(clusters: DataFrame, by: tuple[str, ...] = ("party",)) -> DataFrame:
    """Of clusters that begin with the same document: the one of highest confidence, then the longest."""
    w = Window.partitionBy(*by, "doc_id").orderBy(F.desc("confidence"), F.desc("size"))
    return clusters.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def key_events(documents: DataFrame, gap: int = 30) -> DataFrame:
    """Events of a project's documents in order: first, last, a gap of over `gap` days before, a change of type, a change of status."""
    w = Window.partitionBy("project_id").orderBy("date_created", "doc_id")
    d = documents.withColumns({"_d": F.lag("date_created").over(w), "_t": F.lag("doc_type").over(w), "_s": F.lag("status").over(w), "_n": F.lead("doc_id").over(w), "_p": F.lag("doc_id").over(w)})
    kinds = F.array(F.when(F.col("_p").isNull(), "first"), F.when(F.col("_n").isNull(), "last"), F.when(F.datediff("date_created", "_d") > gap, "gap"), F.when(F.col("_t") != F.col("doc_type"), "type change"), F.when(F.col("_s") != F.col("status"), "status change"))
    return d.select("project_id", "doc_id", "date_created", F.explode(F.array_compact(kinds)).alias("event"))


def run_lengths(documents: DataFrame, column: str = "doc_type", by: str = "project_id") -> DataFrame:
    """Run-length encoding of a column over a group's documents in order: run, value, length, first and last date."""
    w = Window.partitionBy(by).orderBy("date_created", "doc_id")
    new = F.when(F.lag(column).over(w).eqNullSafe(F.col(column)) & F.lag("doc_id").over(w).isNotNull(), 0).otherwise(1)
    d = documents.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(by, "run").agg(F.first(column).alias("value"), F.count(F.lit(1)).alias("length"), F.min("date_created").alias("start"), F.max("date_created").alias("end"))


def alternating(documents: DataFrame, least: int = 4, share: float = 0.75) -> DataFrame:
    """Projects of `least` documents whose totals go up and down in turn in at least `share` of their inner places."""
    w = Window.partitionBy("project_id").orderBy("date_created", "doc_id")
    d = documents.withColumns({"_a": F.signum(cents(F.col("total")) - F.lag(cents(F.col("total"))).over(w)), "_b": F.signum(F.lead(cents(F.col("total"))).over(w) - cents(F.col("total")))})
    g = d.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_a") * F.col("_b") < 0, 1).otherwise(0)).alias("turns"))
    return g.filter((F.col("n") >= least) & (F.col("turns") >= share * (F.col("n") - 2)))


def same_day_of_month(documents: DataFrame, by: tuple[str, ...] = ("project_id",), least: int = 3, share: float = 0.3) -> DataFrame:
    """Days of the month on which at least `least`, and a share, of a group's documents fall."""
    n = documents.groupBy(*by, F.dayofmonth("date_created").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("of", F.sum("n").over(Window.partitionBy(*by))).filter((F.col("n") >= least) & (F.col("n") >= share * F.col("of")))


def type_trigrams(documents: DataFrame) -> DataFrame:
    """How often three document types follow each other within projects."""
    w = Window.partitionBy("project_id").orderBy("date_created", "doc_id")
    d = documents.select(F.col("doc_type").alias("first"), F.lead("doc_type").over(w).alias("second"), F.lead("doc_type", 2).over(w).alias("third"))
    return d.filter("third IS NOT NULL").groupBy("first", "second", "third").agg(F.count(F.lit(1)).alias("n"))


def amounts_before_approval(items: DataFrame, documents: DataFrame, per_mille: int = 10) -> DataFrame:
    """Payment and invoice items whose amount is within per_mille thousandths of a change order of the project that isn't rejected and is dated over a day later. Confidence 0.7, up to 0.2 for days and 0.1 for their number."""
    p = items.filter(F.col("doc_type").isin("payment_app", "invoice")).select("project_id", "item_id", "doc_id", cents(F.col("amount")).alias("c"), F.col("date_created").alias("billed"), near_bin(F.col("amount"), per_mille).alias("bin"))
    o = documents.filter("doc_type = 'change_order' AND status != 'rejected'").select("project_id", F.col("doc_id").alias("order_id"), cents(F.col("total")).alias("oc"), F.col("date_created").alias("ordered"), F.explode(near_bins(F.col("total"), per_mille)).alias("bin"))
    j = p.join(o, ["project_id", "bin"]).filter((F.datediff("ordered", "billed") > 1) & (F.abs(F.col("c") - F.col("oc")) * 1000 <= per_mille * F.col("oc")))
    g = j.groupBy("project_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff("ordered", "billed")).alias("days"))
    return g.withColumn("confidence", 0.7 + F.least(F.col("days") / 30, F.lit(0.2)) + F.least(F.col("n") / 2, F.lit(0.1)))


def running_totals(applications: DataFrame) -> DataFrame:
    """Payment applications in order with what was earned before and whether earned less that is what they request, to 0.1 %."""
    w = Window.partitionBy("project_id").orderBy("number")
    before = F.coalesce(F.lag("earned").over(w), F.lit(0).cast("decimal(25,2)"))
    a = applications.withColumn("previous", before)
    due = cents_wide(F.col("earned")) - cents_wide(F.col("previous"))
    return a.withColumn("consistent", F.abs(due - cents_wide(F.col("requested"))) * 1000 <= F.abs(cents_wide(F.col("requested"))))


def cents_wide(amount: Column) -> Column:
    return (amount * 100).cast("decimal(30,0)")


def combined_amounts(items: DataFrame, most: float = 1000.0, days: int = 90, per_mille: int = 100) -> DataFrame:
    """Small items of a document (each under `most`, two or more) and the later item of the project, at most `days` days on, nearest to their sum and within per_mille of it."""
    s = items.filter(F.col("amount") < most).groupBy("project_id", "doc_id", "date_created").agg(F.count(F.lit(1)).alias("parts"), F.sum(cents(F.col("amount"))).alias("s")).filter("parts >= 2")
    s = s.withColumn("bin", F.explode(near_bins(F.col("s"), per_mille)))
    later = items.select("project_id", F.col("item_id").alias("later_id"), F.col("doc_id").alias("later_doc"), F.col("date_created").alias("later"), cents(F.col("amount")).alias("c")).withColumn("bin", near_bin(F.col("c"), per_mille))
    j = s.join(later, ["project_id", "bin"]).drop("bin").filter(F.datediff("later", "date_created").between(1, days) & (F.abs(F.col("c") - F.col("s")) * 1000 <= per_mille * F.col("s")))
    w = Window.partitionBy("project_id", "doc_id").orderBy(F.abs(F.col("c") - F.col("s")), "later_id")
    return j.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def part_confidence(off: Column, whole: Column, parts: Column, alike: Column) -> Column:
    """0.7, up to 0.15 for a small difference, 0.02 for each part after the first and for each alike in words, up to 0.1 each; at most 0.95."""
    near = F.greatest(F.lit(0.0), 0.15 * (1 - F.least(F.lit(1.0), F.abs(off) / whole * 10)))
    return F.least(F.lit(0.95), 0.7 + near + F.least(F.lit(0.1), (parts - 1) * 0.02) + F.least(F.lit(0.1), alike * 0.02))


def combined_confidence(found: DataFrame, items: DataFrame, most: float = 1000.0, least_alike: float = 0.6) -> DataFrame:
    """Rows of combined_amounts with alike, the parts whose description shares `least_alike` of the words with the later item's, and confidence."""
    name = items.select(F.col("item_id").alias("later_id"), F.col("description").alias("_later")).dropDuplicates(["later_id"])
    parts = items.filter(F.col("amount") < most).select("doc_id", F.col("description").alias("_part"))
    like = (jaccard(word_set(F.col("_later")), word_set(F.col("_part"))) >= least_alike).cast("int")
    n = found.select("doc_id", "later_id").join(name, "later_id").join(parts, "doc_id").groupBy("doc_id", "later_id").agg(F.sum(like).alias("alike"))
    return found.join(n, ["doc_id", "later_id"]).withColumn("confidence", part_confidence(F.col("c") - F.col("s"), F.col("s"), F.col("parts"), F.col("alike")))


def split_amounts(items: DataFrame, least: float = 1000.0, days: int = 90, per_mille: int = 100) -> DataFrame:
    """Items over `least` and the later, smaller items of their project (at most `days` days on) that, taken largest first while they fit, sum to within per_mille of them.

    The greedy sum is a fold over an item's candidates, which are those of one project in the time span. alike: parts whose description
    shares 60 % of its words with the item's.
    """
    big = items.filter(F.col("amount") > least).select("project_id", F.col("item_id").alias("big_id"), F.col("doc_id").alias("big_doc"), F.col("description").alias("text0"), F.col("date_created").alias("d0"), cents(F.col("amount")).alias("whole"), F.explode(F.array(day_bin(F.col("date_created"), days), day_bin(F.col("date_created"), days) + 1)).alias("bin"))
    small = items.select("project_id", "item_id", F.col("description").alias("text1"), F.col("date_created").alias("d1"), cents(F.col("amount")).alias("c"), day_bin(F.col("date_created"), days).alias("bin")).filter("c > 0")
    j = big.join(small, ["project_id", "bin"]).filter(F.datediff("d1", "d0").between(1, days) & (F.col("c") < F.col("whole")))
    g = j.groupBy("project_id", "big_id", "whole").agg(F.sort_array(F.collect_list(F.struct("c", "item_id", (jaccard(word_set(F.col("text0")), word_set(F.col("text1"))) >= 0.6).cast("int").alias("like"))), asc=False).alias("parts"))
    step = lambda s, x: F.when(s["t"] + x["c"] <= F.col("whole") * (1000 + per_mille) / 1000, F.struct((s["t"] + x["c"]).alias("t"), (s["n"] + 1).alias("n"), (s["like"] + x["like"]).alias("like"))).otherwise(s)
    f = g.withColumn("f", F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("like")), step)).select("project_id", "big_id", "whole", F.col("f.t").alias("sum"), F.col("f.n").alias("n"), F.col("f.like").alias("alike"))
    f = f.filter((F.col("n") >= 2) & (F.abs(F.col("sum") - F.col("whole")) * 1000 <= per_mille * F.col("whole")))
    return f.withColumn("confidence", part_confidence(F.col("sum") - F.col("whole"), F.col("whole"), F.col("n"), F.col("alike")))
