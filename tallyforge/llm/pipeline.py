"""Stages of a training corpus: each takes (spark, docs, sf_dir) and returns what it keeps, with the columns of docs, or the packed pieces.

Defined results: a document with a null or empty text, one without a letter, or one whose language has a score under SURE goes with the
first stage, and a null lang takes the language found; one without an id is no
near-duplicate of anything and goes on to the others; of rows that share an id, as of near-duplicates, one stays (the smallest id, of that
the smallest text); a text that only repeats itself stays; an empty table gives no pieces; other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontaminate, langid, neardup, packing, runtime, secretscan
from tallyforge.llm.queries import tokenizer_path

#: Words of a shingle; percent of shingles in common; words of a benchmark window; tokens of a sequence and the id that ends a document.
SHINGLE, PERCENT, WINDOW, LENGTH, END = 5, 80, 10, 4096, 2
#: Least score of a document's language: more probable than all others together.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, which they carry where they had none; the others (no text, no letter, no language more probable than the rest) go. Of tables without labels only those with no letter go."""
    model = langid.train(docs)
    return langid.keep(docs, model, SURE if model else 0.0, "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in text, and n_chars counted anew where text has changed."""
    return secretscan.redact(docs, length_column="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, tokenizer_path(), LENGTH, END)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written to the shared folder, read by the next, and deleted when that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = runtime.stored(docs, name)
            runtime.drop(before)  # what the stage has read; the tables given stay
    return docs
