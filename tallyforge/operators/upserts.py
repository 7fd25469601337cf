"""Writing rules as DataFrames: insert if absent, latest wins, fill nulls, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.schema import KEYS, TABLES


def insert_absent(known: DataFrame, fresh: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """known, and the first fresh row (by order) of each key that known lacks."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = fresh.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return known.unionByName(first.join(known.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def registered(table: str, known: DataFrame, fresh: DataFrame, order: str | None = None) -> DataFrame:
    """A table of the model with fresh rows put in: those with a known key are left out, of fresh ones with the same key the first (by order) counts.

    fresh may lack columns, which are then null, and have others, which are dropped. A table without a key takes all rows.
    """
    types = known.sparkSession.createDataFrame([], TABLES[table]).schema
    whole = lambda df: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in types))
    keys = KEYS.get(table, ())
    return insert_absent(whole(known), whole(fresh), keys, order or keys[0]) if keys else whole(known).unionByName(whole(fresh))


def latest(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """The row of highest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def merged(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """One row for each key: of every column the value of highest version that isn't null."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    value = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(c)
    return rows.groupBy(*keys).agg(*(value(c) for c in rest), F.max(version).alias(version))


def soft_delete(documents: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """documents with status deleted for those in doc_ids."""
    gone = doc_ids.select("doc_id", F.lit(True).alias("_gone")).distinct()
    return documents.join(gone, "doc_id", "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def hard_delete(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables with a doc_id, without the rows of those documents."""
    ids = doc_ids.select("doc_id").distinct()
    return {name: t.join(ids, "doc_id", "left_anti") if "doc_id" in t.columns else t for name, t in tables.items()}


def write_project(df: DataFrame, path: str, project: str = "project_id", mode: str = "append") -> None:
    """One folder for each project, so a project is read, replaced or deleted alone. Names are letters, digits and underscores; others raise."""
    df = df.withColumn(project, F.when(F.col(project).cast("string").rlike("^[A-Za-z0-9_]+$"), F.col(project)).otherwise(F.raise_error(F.concat(F.lit("no project name: "), F.coalesce(F.col(project).cast("string"), F.lit("null"))))))
    df.write.partitionBy(project).mode(mode).parquet(path)
