"""Order within groups without a task that holds a group: ranks by range partitions, and windows over overlapping blocks of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.storage import stored

#: Ranks of a block of overlapping windows.
BLOCK = 4096


def ranked(rows: DataFrame, by: tuple[str, ...], *order: Column | str, out: str = "rank", carry: tuple[str, ...] | None = None) -> DataFrame:
    """rows with their 0-based place in their group's order, which should be total; null groups are a group.

    Rows are partitioned by ranges of group and order, sorted and written once. A row's place is its place among its partition's rows of
    the group, and what earlier partitions have of that group: one row for each partition and group that lies in it. carry: the columns to
    keep, `by` among them, where not all are wanted; others are sorted by and not written.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    sort = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    columns = rows.columns if carry is None else list(carry)
    kept = stored(sort.select(*columns, F.monotonically_increasing_id().alias("_at")), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = kept.groupBy(part, *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"_{c}_") for c in by), F.col("_part").alias("_p_"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_low")
    on = F.shiftright(F.col("_at"), 33) == F.col("_p_")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return kept.join(sizes, on).select(*columns, (F.col("_before") + F.col("_at") - F.col("_low")).alias(out))


def blocked(rows: DataFrame, by: tuple[str, ...], reach: int, rank: str = "rank", block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """rows with _block and _own, and the columns to partition windows by: blocks of `block` ranks of a group, with the next `reach` rows of the next block repeated.

    A window over them that looks at most `reach` rows ahead is right for rows where _own is true.
    """
    at = F.floor(F.col(rank) / block)
    also = F.when((F.col(rank) % block < reach) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    dealt = rows.withColumn("_block", F.explode(also)).withColumn("_own", F.col("_block") == F.floor(F.col(rank) / block))
    return dealt, [*by, "_block"]
