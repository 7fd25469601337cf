"""Secret scans: patterns, and multipart credential linking by an interval join. DataFrame functions only.

Strong parts are reported wherever they stand: assignments of a value to a secret's name, access identifiers, long hex runs. Weak parts
(temporary or role identifiers, 40-character keys, endpoints) are common in clean text, so they are reported only beside what completes
them: an identifier and a secret within SCOPE code points of each other, and an endpoint within the scope of both. Parts are binned by
start, so the join is an equality of document and bin with a test of distance, and a bin holds few parts however long the text is.

A pattern's matches are found by regexp_extract_all and its gaps by split with the same pattern; running sums of their lengths are the
positions, in code points.

Defined results: a null or empty text has no spans; overlapping spans of different kinds are all reported; repeated rows are judged each
by itself; an empty table gives no rows; other columns are not read by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime

#: Code points between the starts of linked parts.
SCOPE = 400
#: Parts gathered at once in a fold; code points of a piece in which positions are sought.
BLOCK, PIECE = 256, 1024

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What a text with an assignment has; tested first, since few texts do.
_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Runs that are too short are dropped; as a run is taken whole from its first character on, asking for the length at once finds the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"(?<![A-Z0-9])(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|s3|amqps?|postgres(?:ql)?|mysql|mongodb|redis)://[A-Za-z0-9.@:_-]+"

#: Order of kinds that start at the same place; the first three are the base.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _walk(parts: Column, zero: Column, step, out: str) -> Column:
    """A fold over parts that keeps a state and gives at most one element a part: struct of now, the last state, and out, all elements.

    Elements are gathered in blocks of BLOCK parts and the blocks joined at the end, so the time is in proportion to the number of parts.
    """
    none = F.array().cast(f"array<{out}>")
    blocks = _let(parts, lambda every: F.transform(F.sequence(F.lit(0), F.floor(F.size(every) / BLOCK).cast("int")), lambda k: F.slice(every, k * BLOCK + 1, F.lit(BLOCK))))

    def one(state: Column, x: Column) -> Column:
        now, new = step(state["now"], x)
        return F.struct(now.alias("now"), F.when(new.isNotNull(), F.concat(state["out"], F.array(new))).otherwise(state["out"]).alias("out"))

    def block(state: Column, xs: Column) -> Column:
        got = F.aggregate(xs, F.struct(state["now"].alias("now"), none.alias("out")), one)
        return _let(got, lambda g: F.struct(g["now"].alias("now"), F.concat(state["out"], F.array(g["out"])).alias("out")))

    zero = F.struct(zero.alias("now"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.aggregate(blocks, zero, block, lambda s: F.struct(s["now"].alias("now"), F.flatten(s["out"]).alias("out")))


def _spans(text: Column, kind: str, pattern: str, head: str | None = None, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, rank, end, kind>> of a pattern's matches, leftmost first, without those whose group is shorter than `least`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("g"), found.alias("m"))
    long_enough = lambda m: F.length(m) > 0 if not group else F.length(F.regexp_extract(m, pattern, group)) >= least

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["g"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return end, F.when(long_enough(x["m"]), F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))

    every = _walk(parts, F.lit(0), step, "struct<start:int,rank:int,end:int,kind:string>")
    return F.when(text.rlike(head or pattern), every["out"]).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def _parts(text: Column) -> tuple[Column, Column]:
    """Strong and weak parts of a text."""
    strong = F.concat(_spans(text, "assign", ASSIGN, _ASSIGN_HEAD, 2, 12), _spans(text, "access", ACCESS), _spans(text, "hex", HEX))
    weak = F.concat(_spans(text, "id", WEAK_ID), _spans(text, "secret", WEAK_SECRET), _spans(text, "endpoint", ENDPOINT))
    return strong, weak


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """_row and linked: the weak parts of each row of found (_row, strong, weak) that complete each other or a strong part.

    An interval join: every part's scope [start - scope, start + scope] with the parts that start in it.
    """
    some = found.filter(F.size("weak") > 0).select("_row", F.explode(F.concat("strong", "weak")).alias("p"))
    role = F.when(F.col("p.kind").isin("access", "id"), "i").when(F.col("p.kind") == "endpoint", "e").otherwise("s")
    parts = some.select("_row", "p", role.alias("role"), F.floor(F.col("p.start") / scope).alias("bin"))
    weak = parts.filter(F.col("p.rank") >= 3).select("_row", F.col("p").alias("w"), F.col("role").alias("of"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = weak.join(parts.filter("role != 'e'"), ["_row", "bin"]).filter((F.abs(F.col("w.start") - F.col("p.start")) <= scope) & (F.col("of") != F.col("role")))
    has = near.groupBy("_row", "w", "of").agg(F.max(F.col("role") == "i").alias("i"), F.max(F.col("role") == "s").alias("s"))
    whole = has.filter("(of = 'i' and s) or (of = 's' and i) or (of = 'e' and i and s)")
    return whole.groupBy("_row").agg(F.collect_list("w").alias("linked"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """For each row of docs (doc_id, text): counts and a digest of the base spans, and all spans reported, as kind:start:end by start, then kind."""
    runtime.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    strong, weak = _parts(F.col("_text"))
    found = runtime.stored(rows.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.array_sort(strong).alias("strong"), weak.alias("weak")), "secrets")
    out = found.join(_linked(found, scope), "_row", "left")
    count = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat(F.col("strong"), F.coalesce("linked", F.filter("strong", lambda x: F.lit(False)))))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE, length_column: str | None = None) -> DataFrame:
    """docs with all its columns, where each run of overlapping spans in text is replaced by mark. Rows without spans stay as they are, null texts included.

    length_column: a column that holds the text's length, counted anew where text changes.
    """
    runtime.prepare(docs.sparkSession)
    strong, weak = _parts(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = runtime.stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"), F.array_sort(strong).alias("strong"), weak.alias("weak")), "redact")
    plain = found.filter(F.size("weak") == 0).select("doc", F.col("strong").alias("spans"))
    other = found.filter(F.size("weak") > 0).join(_linked(found.select("_row", "strong", "weak"), scope), "_row", "left")
    other = other.select("doc", F.array_sort(F.concat("strong", F.coalesce("linked", F.filter("strong", lambda x: F.lit(False))))).alias("spans"))
    text = F.col("doc.text")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        """The end of the spans so far, and the stretch of text before a span that doesn't overlap them."""
        return F.greatest(at, x["end"]), F.when((x["start"] >= at) | (at == 0), F.struct(at.alias("start"), x["start"].alias("end")))

    # Positions are sought in pieces of PIECE code points, not from the text's beginning each time.
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))

    def part(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        some = F.slice(cut, first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
        return F.substring(F.array_join(some, ""), start - first * PIECE + 1, end - start)

    def clean(cut: Column) -> Column:
        whole = lambda w: F.concat(F.array_join(F.transform(w["out"], lambda x: F.concat(part(cut, x["start"], x["end"]), F.lit(mark))), ""), part(cut, w["now"], F.length(text)))
        return _let(_walk(F.col("spans"), F.lit(0), step, "struct<start:int,end:int>"), whole)

    walked = _let(pieces, clean)
    has = F.size("spans") > 0
    rows = plain.unionByName(other).select("doc", F.when(has, walked).otherwise(text).alias("clean"), has.alias("has"))
    doc = F.col("doc").withField("text", F.col("clean"))
    if length_column:
        doc = doc.withField(length_column, F.when(F.col("has"), F.length("clean").cast(docs.schema[length_column].dataType)).otherwise(F.col(f"doc.{length_column}")))
    return rows.select(doc.alias("doc")).select("doc.*")
