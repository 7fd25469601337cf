"""Columns about money. Amounts are DECIMAL(15,2); comparisons are made on whole cents, so they are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Round amounts and how suspicious each is, largest first (fixed values).
ROUNDNESS = ((100000, 0.95), (50000, 0.9), (10000, 0.85), (5000, 0.8), (1000, 0.75), (500, 0.7), (100, 0.65), (50, 0.6), (25, 0.55), (10, 0.5), (5, 0.45))
#: Rates (fixed values).
MARKUP_RATES = (0.05, 0.0625, 0.07, 0.08, 0.0875, 0.10, 0.15, 0.20, 0.25)
TAX_RATES = (0.05, 0.0625, 0.07, 0.0775, 0.08, 0.0825, 0.0875, 0.09, 0.095, 0.10)
ITEM_MARKUPS = (0.05, 0.0625, 0.07, 0.08, 0.10, 0.15, 0.20)


def cents(amount: Column) -> Column:
    return (amount.cast("decimal(15,2)") * 100).cast("long")


def within_abs(a: Column, b: Column | float, tolerance: float = 0.01) -> Column:
    """Amounts at most `tolerance` apart."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(cents(a) - cents(b)) <= round(tolerance * 100)


def within_rel(a: Column, b: Column, per_mille: int = 10) -> Column:
    """a differs from b by at most per_mille thousandths of b."""
    return F.abs(cents(a) - cents(b)) * 1000 <= per_mille * F.abs(cents(b))


def log_bin(amount: Column, per_mille: int) -> Column:
    """A bin such that positive amounts within per_mille of each other lie in the same or neighbouring bins. The width is -ln(1 - tolerance)."""
    import math

    return F.floor(F.log(amount.cast("double")) / -math.log(1 - per_mille / 1000)).cast("long")


def near_bins(amount: Column, per_mille: int) -> Column:
    """The bins that amounts within per_mille of this one may lie in; for explode()."""
    at = near_bin(amount, per_mille)
    return F.array(at - 1, at, at + 1)


def near_bin(amount: Column, per_mille: int) -> Column:
    """log_bin; amounts that aren't positive lie in one bin of their own, as they are only near their equals."""
    return F.coalesce(F.when(amount > 0, log_bin(amount, per_mille)), F.lit(-(1 << 40)))


def normalize_amount(text: Column) -> Column:
    """A number from text: parentheses are negative; currency signs, commas and blanks go; null if no number is left."""
    bare = F.regexp_replace(F.trim(text), r"[$€£¥,\s()]", "")
    value = bare.try_cast("double")
    return F.when(F.trim(text).rlike(r"^\(.*\)$"), -value).otherwise(value)


def format_currency(amount: Column) -> Column:
    return F.when(amount.isNull(), "N/A").otherwise(F.concat(F.lit("$"), F.format_number(amount, 2)))


def round_to_nearest(value: Column, nearest: float = 0.01) -> Column:
    """Half to even."""
    return F.bround(value / nearest) * nearest


def percentage(part: Column, whole: Column) -> Column:
    """Null if whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def roundness(amount: Column) -> Column:
    """0 to 0.95: how round an amount looks. The ladder for whole amounts, 0.7 for four equal digits, 0.6 for prices like 999; a size factor up to 0.1; times 0.8 with cents."""
    c = cents(amount)
    # Steps are whole amounts, so few rows look at them. Written out one by one, they make code too long to be compiled.
    steps = F.array(*(F.struct(F.lit(step * 100).cast("long").alias("step"), F.lit(score).alias("score")) for step, score in ROUNDNESS))
    first = F.get(F.filter(steps, lambda x: (c >= x["step"]) & (c % x["step"] == 0)), F.lit(0))["score"]
    ladder = F.when(c % 100 == 0, F.coalesce(first, F.lit(0.0))).otherwise(0.0)
    digits = F.floor(c / 100).cast("string")
    base = F.when(ladder > 0, ladder).when(digits.rlike(r"(\d)\1{3}"), 0.7).when(digits.rlike("9{3}$") | ((c % 100 >= 95) & (c > 1000)), 0.6).otherwise(0.0)
    size = F.least(F.lit(0.1), c / 100 / 1_000_000 * 0.1)
    return F.when(base == 0, 0.0).otherwise(F.least(F.lit(0.95), (base + size) * F.when(c % 100 != 0, 0.8).otherwise(1.0)))


def split_rates(rates: tuple[float, ...]) -> Column:
    """An array column of literal rates, for explode()."""
    return F.array(*(F.lit(r) for r in rates))
