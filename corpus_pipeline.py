"""A training corpus from documents: language ID, near-dedup, benchmark decontamination, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.pipeline import STAGES, run

#: Learned language scores and signature forests have no SQL form; tests compare run() with a plain version on small tables.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "oracle_sql", "queries", "run"]


def queries() -> dict:
    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir)

    return {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
