"""Session settings and shared storage that the operators of this subpackage rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.shipping import ship
from tallyforge.storage import drop, shared_dir, stored

__all__ = ["drop", "offsets", "prepare", "shared_dir", "stored"]

#: Rows in an Arrow batch; bytes in one, which a single longer text may exceed.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for the session: small Arrow batches, bounded in bytes, and shuffle files that go when their job is over.

    Every operator writes what a later job needs to the shared folder, so no later job reads an earlier job's shuffle.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def offsets(totals: DataFrame, part: str, amount: str, out: str) -> DataFrame:
    """For each part: the sum of amount over all parts before it. totals has one row per partition or file, so one task holds it."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long").alias(out))
