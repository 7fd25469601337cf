"""Token ids as Parquet list columns: dictionary or delta encoding, small row groups and page indexes.

Files hold the documents in ascending doc_id, one row for each: doc_id, shard, row, n_tokens, shard_start, ids. Ids repeat, so they
are dictionary-coded; doc_id, row and shard_start rise, so they are delta-coded (Parquet's second data page version). Row groups and
pages are kept small, and each column chunk has its column and offset index, so a reader can take metadata alone, or the ids of a few
documents, without reading the rest.

Defined results: a null or empty text has only the end token; rows with the same doc_id stand beside each other, ordered by text; an
empty table gives an empty file set; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime
from tallyforge.llm.text import slices

#: Of Parquet's writer. Dictionary pages up to 1 MB hold a vocabulary of 250,000 ids.
FORMAT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#row": "false",
    "parquet.enable.dictionary#shard_start": "false",
}
SCHEMA = "doc_id long, shard int, row long, n_tokens long, shard_start long, ids array<int>"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode doc_id, text; write the files in doc_id order to the shared folder; and read them: a DataFrame with the columns of SCHEMA."""
    runtime.prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.tokens import WordEncoder

        encoder, shard, row, start = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                n = hi - lo
                ids, at = encoder.encode(data, offs)
                ids = np.insert(ids.astype(np.int32), at[1:], end_id)
                at = at + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(np.arange(row, row + n)),
                        pa.array(np.diff(at)),
                        pa.array(start + at[:-1]),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "shard", "row", "n_tokens", "shard_start", "ids"],
                )
                row, start = row + n, start + int(at[-1])

    # Rows of one id, or without, are dealt by their texts' hashes, and equal rows by where they were read.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"h": F.xxhash64("text"), "k": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "h", "k").sortWithinPartitions("doc_id", "h", "k")
    return runtime.stored(dealt.select("doc_id", "text").mapInArrow(encode, SCHEMA), "tokens", **FORMAT)


def starts(tokens: DataFrame) -> DataFrame:
    """doc_id, shard, row, n_tokens and start, the ids of all documents before it, from the metadata columns alone."""
    shards = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = runtime.offsets(shards, "shard", "n", "before")
    return tokens.join(F.broadcast(before), "shard").select("doc_id", "shard", "row", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every document in the files."""
    shards = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = runtime.offsets(shards, "shard", "n", "before")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = tokens.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")
    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def select(tokens: DataFrame, low: int, high: int) -> DataFrame:
    """The documents with doc_id from low to high. Files are in that order, so row groups and pages outside the range are skipped by their statistics."""
    return tokens.filter(F.col("doc_id").between(low, high))
