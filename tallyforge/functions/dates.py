"""Columns about dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In the order they are tried (fixed values).
FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/M/d", "M-d-yyyy")


def parse_date(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in FORMATS))


def day_bin(date: Column, days: int) -> Column:
    """Bins of `days` days: a date at most `days` days before another lies in the same bin or the one before."""
    return F.floor(F.unix_date(date) / days)


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def end_of_month(date: Column, days: int = 3) -> Column:
    """Whether a date is among the last `days` of its month."""
    return F.dayofmonth(date) > F.dayofmonth(F.last_day(date)) - days


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """day, name of US holidays: Jan 1, Jul 4, Dec 24, 25 and 31, Memorial Day, Labor Day, Thanksgiving and the day after. Ten rows a year."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    at = lambda m, d: F.make_date("y", F.lit(m), F.lit(d))
    memorial = F.date_sub(at(5, 31), F.weekday(at(5, 31)))
    labor = F.date_add(at(9, 1), F.pmod(-F.weekday(at(9, 1)), F.lit(7)))
    thanks = F.date_add(at(11, 22), F.pmod(3 - F.weekday(at(11, 22)), F.lit(7)))
    days = [(at(1, 1), "New Year"), (memorial, "Memorial Day"), (at(7, 4), "Independence Day"), (labor, "Labor Day"), (thanks, "Thanksgiving"), (F.date_add(thanks, 1), "Day after Thanksgiving"), (at(12, 24), "Christmas Eve"), (at(12, 25), "Christmas"), (at(12, 31), "New Year's Eve")]
    return years.select(F.explode(F.array(*(F.struct(d.alias("day"), F.lit(n).alias("name")) for d, n in days))).alias("h")).select("h.*")
