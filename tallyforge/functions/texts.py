"""Columns about descriptions and document text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists (fixed values).
SUSPICIOUS = ("extra", "additional", "adjustment", "misc", "miscellaneous", "other", "contingency", "allowance", "unforeseen", "unknown", "tbd")
VAGUE = ("etc", "...", "misc", "other", "additional")
EXCLUDED_COST_CODES = ("overhead", "profit", "insurance", "bond", "fee")
TOTAL_WORDS = ("total", "sum", "grand", "contract")
REJECTED = ("reject", "denied", "decline")
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "each", "have", "will", "include", "including")
SUBSTITUTIONS = (
    ("reinforcement", "support"), ("reinforcement", "bracing"), ("hvac equipment", "mechanical equipment"), ("hvac", "mechanical"), ("ceiling", "roof"),
    ("additional", "supplemental"), ("equipment support", "equipment mounting"), ("structural steel", "steel members"), ("new", "additional"),
    ("upgrade", "modification"), ("mounting", "connection"), ("steel members", "steel reinforcement"), ("seismic", "structural"), ("vibration", "seismic"),
)
TECHNICAL = (
    "structural", "reinforcement", "steel", "support", "hvac", "equipment", "mechanical", "electrical", "seismic", "bracing", "ceiling", "mounting", "installation",
    "connection", "waterproofing", "concrete", "fastener", "connector", "beam", "column", "joist", "bracket", "anchoring", "load", "bearing", "frame", "vibration", "isolation", "engineering",
)
HVAC = ("hvac", "heating", "ventilation", "air conditioning", "cooling", "equipment", "mechanical", "air handler", "condenser", "compressor")
DELIVERY = ("delivery", "equipment", "deliver", "shipment", "arrival", "receive")
CONSTRUCTION = (
    "electrical", "hvac", "plumbing", "concrete", "foundation", "steel", "framing", "drywall", "insulation", "roofing", "window", "door", "flooring", "ceiling",
    "lighting", "paint", "finish", "hardware", "cabinet", "counter", "tile", "mechanical", "excavation", "grading", "demolition", "abatement", "remediation",
)


def normalize(text: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w]+", " "))


def compatible(text: Column) -> Column:
    """Unicode's compatibility form (NFKC): ligatures, full-width and circled characters as plain ones, letters and their marks composed; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(texts)).as_py() is not False:  # nothing to do, as for most batches
            return texts
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def prepared(text: Column, compatible_form: bool = True, blanks: bool = True, lower: bool = False) -> Column:
    """Text before it is cut: compatibility form, runs of white space to one blank and none at the ends, lower case, as asked for; null is empty."""
    out = compatible(F.coalesce(text, F.lit(""))) if compatible_form else F.coalesce(text, F.lit(""))
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " ")) if blanks else out
    return F.lower(out) if lower else out


def plain(text: Column) -> Column:
    """Lower case, each mark of punctuation a blank."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")


def has_part(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of the parts stands anywhere in the lower-cased text; false for a null text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for x in parts:
        out |= low.contains(x)
    return out


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))


def blended_similarity(a: Column, b: Column) -> Column:
    """0.3 words + 0.2 bigrams + 0.2 technical terms (Jaccard each) + 0.3 if one side of a substitution stands in the one text, and its other side instead of it in the other."""
    wa, wb, ta, tb = word_set(a), word_set(b), plain(a), plain(b)
    terms = F.array(*(F.lit(x) for x in TECHNICAL))
    pair = F.lit(False)
    for x, y in SUBSTITUTIONS:
        pair |= (ta.contains(x) & tb.contains(y) & ~tb.contains(x)) | (ta.contains(y) & tb.contains(x) & ~tb.contains(y))
    row = lambda t: F.array_distinct(bigrams(F.filter(F.split(normalize(t), " "), lambda x: x != "")))
    return 0.3 * jaccard(wa, wb) + 0.2 * jaccard(row(a), row(b)) + 0.2 * jaccard(F.array_intersect(wa, terms), F.array_intersect(wb, terms)) + F.when(pair, 0.3).otherwise(0.0)


def keywords(text: Column) -> Column:
    """Words of more than three letters that are no stop words."""
    return F.array_except(F.filter(word_set(text), lambda x: F.length(x) > 3), F.array(*(F.lit(x) for x in STOP_WORDS)))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text as a whole word."""
    return F.coalesce(F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(False))


def suspiciousness(description: Column, amount: Column) -> Column:
    """0 to 1: empty 0.9; short +0.4 or +0.3; a suspicious word +0.3; a vague one +0.2; over 100,000 with under 15 characters +0.3."""
    text = F.trim(F.coalesce(description, F.lit("")))
    n = F.length(text)
    vague = F.lit(False)
    for x in VAGUE:
        vague |= F.lower(text).contains(x)
    score = F.when(n < 5, 0.4).when(n < 10, 0.3).otherwise(0.0) + F.when(any_word(text, SUSPICIOUS), 0.3).otherwise(0.0) + F.when(vague, 0.2).otherwise(0.0) + F.when((amount > 100_000) & (n < 15), 0.3).otherwise(0.0)
    return F.when(n == 0, 0.9).otherwise(F.least(F.lit(1.0), score))


def snippet(text: Column, word: str, around: int = 100) -> Column:
    """Up to `around` characters on either side of the first occurrence, whatever its case."""
    at = F.instr(F.lower(text), word.lower())
    start = F.greatest(F.lit(1), at - around)
    return F.substring(text, start, at - start + len(word) + around)


def band(value: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


def confidence_level(value: Column) -> Column:
    return band(value, ((0.9, "Very High"), (0.75, "High"), (0.6, "Medium"), (0.4, "Low")), "Very Low")


def severity_level(value: Column) -> Column:
    return band(value, ((0.8, "Critical"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")), "Negligible")
