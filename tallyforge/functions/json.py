"""Columns about JSON text and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_get(data: Column, path: str, default=None) -> Column:
    """The value at a dotted path in JSON text, as text; default where it is missing or the text is no JSON."""
    value = F.try_variant_get(F.try_parse_json(data), "$." + path, "string")
    return F.coalesce(value, F.lit(default)) if default is not None else value


def number_at(data: Column, path: str) -> Column:
    """The number at a dotted path in JSON text; null if it is none."""
    return number_in(F.try_parse_json(data), path)


def number_in(parsed: Column, path: str) -> Column:
    """number_at() of a column that is parsed once, for many numbers of a text."""
    return F.try_variant_get(parsed, "$." + path, "string").try_cast("double")


def merged(first: Column, second: Column) -> Column:
    """Two maps; where both have a key the second's value stands."""
    rest = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_concat(rest, second)


def as_json(*columns: str) -> Column:
    """The columns as JSON text: dates as ISO text, decimals as numbers, nulls left out."""
    return F.to_json(F.struct(*columns))


def as_list(value: Column) -> Column:
    """A value as an array of it; null is an empty array."""
    return F.array_compact(F.array(value))
