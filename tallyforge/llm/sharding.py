"""Shuffled shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in order of their key. A balanced Feistel network of ROUNDS rounds permutes 0 to 4**k - 1, the smallest
such range that holds n, and is applied again to whatever falls outside (cycle walking), which permutes 0 to n - 1. Row number p of
the shuffled order goes to shard p mod shards, slot p div shards: counts differ by at most one, slots are gapless, and both ways are
computable from (seed, n, shards) alone.

Defined results: rows with equal keys are numbered in order of size, then checksum, and stay distinct rows; null keys come first; a
null text has no bytes; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime
from tallyforge.llm.text import mix

ROUNDS, SEED = 6, 20_240_917


def half_bits(n: int) -> int:
    """Bits of each half of the network for n rows."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for r in range(ROUNDS)[:: -1 if back else 1]:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        if back:
            left, right = right ^ (mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ key) & mask)
    return left << np.uint64(bits) | right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Images of row numbers x under the permutation of 0 to n - 1; back: those of its inverse."""
    bits, x = half_bits(n), np.asarray(x).astype(np.uint64)
    x = _rounds(x, bits, seed, back) if len(x) else x
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _rounds(x[out], bits, seed, back)
    return x.astype(np.int64)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The row numbers that lie at (shard, slot)."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def permuted(row: Column, n: Column, seed: int = SEED) -> Column:
    """permute() on columns; n is the same in every row."""

    def run(x: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), int(total.iloc[0]), seed) if len(x) else np.zeros(0, np.int64))

    return F.pandas_udf(run, "long")(row, n)


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with row, their global number from 0 in order of keys (then of all columns), and n, how many there are. rows should be narrow.

    A range partition and a sort, written once; then each part's first number from the parts' sizes, one row for each part.
    """
    order = [*keys, *(c for c in rows.columns if c not in keys)]
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    parts = runtime.stored(sort.select("*", F.shiftright(local, 33).cast("int").alias("_part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first, total = runtime.offsets(sizes, "_part", "_n", "_first"), sizes.agg(F.sum("_n").alias("n"))
    return parts.join(F.broadcast(first.crossJoin(F.broadcast(total))), "_part").select(*rows.columns, (F.col("_first") + F.col("_local")).alias("row"), "n")


def shard(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size (bytes of text and 8), text_crc32, law, shard, slot, grown_shard (null: the law is of counts, not keys) and row of each row of doc_id, text."""
    runtime.prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(runtime.stored(narrow, "sizes"), "doc_id").withColumn("_p", permuted(F.col("row"), F.col("n"), seed))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")
