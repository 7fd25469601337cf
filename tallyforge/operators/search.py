"""Vector, keyword and hybrid search; chunking; markers of important content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.texts import normalize
from tallyforge.shipping import ship

#: Markers of structure and their weights (fixed values).
MARKERS = {"header": (r"(?m)^[A-Z][A-Z ]{3,}:?$", 1.5), "list": (r"(?m)^\s*(?:[-*•]|\d+\.)\s", 1.2), "table": (r"\|.+\|", 1.3), "date": (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", 1.4), "currency": (r"\$\s?\d[\d,]*(?:\.\d\d)?", 1.8), "percent": (r"\b\d+(?:\.\d+)?%", 1.5)}
CHUNK, OVERLAP, LEAST = 1000, 200, 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def filtered(vectors: DataFrame, filters: dict) -> DataFrame:
    """Rows whose column equals a value, is in a list, or lies in a (low, high) tuple, for each column of filters."""
    for column, want in filters.items():
        c = F.col(column)
        vectors = vectors.filter(c.isin(want) if isinstance(want, list) else c.between(*want) if isinstance(want, tuple) else c == want)
    return vectors


def vector_search(vectors: DataFrame, query: list[float], limit: int = 5, threshold: float = 0.0, embedding: str = "embedding", key: str = "vec_id", filters: dict | None = None) -> DataFrame:
    """The `limit` vectors of highest cosine (then smallest key) that pass the filters, for one query; for many see vector_ranks()."""
    vectors = filtered(vectors, filters or {})
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", cosine(F.col(embedding), q)).filter(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(limit)


def _packed(rows: DataFrame, key: str, embedding: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of about `size` vectors of one length: their keys, and their values as bytes. Each partition packs its own."""
    schema = f"{names[0]} array<long>, {names[1]} binary, width long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(width: int) -> pa.RecordBatch:
            keys, values = waiting.pop(width)
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([np.array(values, "<f8").tobytes()], pa.binary()), pa.array([width], pa.int64())], names=[*names, "width"])

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k is None or v is None or None in v:
                    continue
                some = waiting.setdefault(len(v), ([], []))
                some[0].append(k)
                some[1].append(v)
                if len(some[0]) >= size:
                    yield block(len(v))
        for width in list(waiting):
            yield block(width)

    return rows.select(F.col(key).cast("long").alias("k"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, schema)


def vector_ranks(vectors: DataFrame, queries: DataFrame, limit: int = 5, threshold: float | None = None, embedding: str = "embedding", key: str = "vec_id", block: int = 1024) -> DataFrame:
    """query_id, rank, key, score: for each of the query vectors (query_id, query), the `limit` nearest vectors by cosine (then smallest key), with a score of `threshold` at least.

    Both tables are packed into blocks of about `block` vectors; each two blocks are multiplied in a task, which keeps the best of each
    query, and those are compared per query. So no task holds more than two blocks, however large the set of queries is. Scores are equal
    if they agree to 10 places. Vectors that are null, have a null, or another length than a query, are near nothing; a zero vector's
    score is 0.
    """
    ship(vectors.sparkSession)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Blocks of vectors are dealt over the partitions, and each of those gets every block of queries: an equality join, however few lengths there are.
    dealt = _packed(vectors, key, embedding, block, ("keys", "data")).withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(parts)))
    asked = _packed(queries, "query_id", "query", block, ("ids", "query")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = dealt.join(asked, ["width", "salt"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(raw: bytes, n: int) -> np.ndarray:
            m = np.frombuffer(raw, "<f8").reshape(n, -1)
            length = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

        for batch in batches:
            for keys, data, ids, query in zip(*(batch.column(c).to_pylist() for c in ("keys", "data", "ids", "query")), strict=True):
                keys = np.array(keys)
                scores = np.round(unit(query, len(ids)) @ unit(data, len(keys)).T, 10) + 0.0
                out: tuple[list, list, list] = ([], [], [])
                for q, row in zip(ids, scores, strict=True):
                    if len(keys) > limit:  # all with the score of the last place, then by key
                        some = np.flatnonzero(row >= np.partition(row, len(row) - limit)[len(row) - limit])
                    else:
                        some = np.arange(len(keys))
                    some = some[np.lexsort((keys[some], -row[some]))[:limit]]
                    if threshold is not None:
                        some = some[row[some] >= threshold]
                    out[0].extend([q] * len(some))
                    out[1].extend(keys[some].tolist())
                    out[2].extend(row[some].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", key, "score"])

    found = pairs.select("keys", "data", "ids", "query").mapInArrow(best, f"query_id long, {key} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "rank", key, "score")


def keyword_scores(pages: DataFrame, query: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pages with any of the query's words: share of the query's words found, plus a hundredth of their occurrences per word of text."""
    words = sorted(set(query.lower().split()))
    tokens = F.filter(F.split(normalize(F.col(text)), " "), lambda x: x != "")
    hits = F.filter("_t", lambda x: x.isin(*words))  # one pass over a text's words, whatever the number of words sought
    p = pages.withColumn("_t", tokens).withColumns({"_h": hits, "words": F.size("_t")}).filter(F.size("_h") > 0)
    p = p.withColumns({"found": F.size(F.array_distinct("_h")), "hits": F.size("_h")})
    return p.withColumn("score", F.col("found") / len(words) + 0.01 * F.col("hits") / F.col("words")).select(key, "found", "hits", "words", "score")


def hybrid_search(pages: DataFrame, vectors: DataFrame, query: str, queries: DataFrame, limit: int = 10, key: str = "doc_id", vector_key: str = "vec_id") -> DataFrame:
    """query_id, key, score, how: for each of the query vectors (query_id, query) the `limit` best of 2 * limit pages by vector and 2 * limit by the words of `query`, merged by id with the higher score."""
    a = vector_ranks(vectors, queries, 2 * limit, 0.0, key=vector_key).select("query_id", F.col(vector_key).alias(key), "score", F.lit("vector").alias("how"))
    b = keyword_scores(pages, query, key=key).orderBy(F.desc("score"), key).limit(2 * limit).select(key, "score", F.lit("keyword").alias("how"))
    # At most 2 * limit rows, for every query.
    b = queries.select("query_id").crossJoin(F.broadcast(b))
    g = a.unionByName(b).groupBy("query_id", key).agg(F.max("score").alias("score"), F.concat_ws("+", F.array_sort(F.collect_set("how"))).alias("how"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return g.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def markers(pages: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """How often each marker of important content occurs in a page, times its weight."""
    n = [F.struct(F.lit(name).alias("marker"), F.regexp_count(F.col(text), F.lit(pattern)).alias("n"), F.lit(weight).alias("weight")) for name, (pattern, weight) in MARKERS.items()]
    return pages.select(key, F.explode(F.array(*n)).alias("m")).select(key, "m.*").filter("n > 0").withColumn("score", F.col("n") * F.col("weight"))


def _cut(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Pieces of at most `size` characters, ended at a paragraph, sentence or word if one ends in the last half; each begins `overlap` before the last one's end."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for mark in ("\n\n", ". ", " "):
                k = text.rfind(mark, at + size // 2, end)
                if k > 0:
                    end = k + len(mark)
                    break
        piece = text[at:end].strip()
        if len(piece) >= least:
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunks(pages: DataFrame, text: str = "text", key: str = "doc_id", size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """key, chunk_index, total_chunks, chunk_length, chunk of every page: overlapping pieces at natural breaks, without those under `least` characters."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: _cut(t or "", size, overlap, least))

    cut = F.pandas_udf(run, "array<string>")
    c = pages.select(key, cut(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    return c.select(key, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "chunk")).withColumn("chunk_length", F.length("chunk"))


def _paragraphs(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Whole paragraphs, as many as fit `size` characters; a longer one is cut alone. Each piece but the first begins with the end of the one before, if that makes it at most a tenth longer than `size`."""
    out, held, n = [], [], 0
    for p in re.split(r"\n\s*\n", text):
        if not p.strip():
            continue
        if n + len(p) + 1 <= size:
            held.append(p)
            n += len(p) + 1
            continue
        if held:
            out.append("\n\n".join(held))
        held, n = ([p], len(p)) if len(p) <= size else ([], 0)
        if not held:
            out += _cut(p, size, overlap, least)
    if held:
        out.append("\n\n".join(held))
    tails = ["", *(p[-overlap:] if overlap else "" for p in out[:-1])]
    return [tail + "\n\n" + p if tail and len(tail) + len(p) <= size * 1.1 else p for tail, p in zip(tails, out, strict=False)]


def structured_chunks(pages: DataFrame, text: str = "text", key: str = "doc_id", size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST, contract: Column | None = None) -> DataFrame:
    """As chunks(), by paragraphs. contract: a condition on rows that get smaller pieces (800) with an overlap of at least 150."""
    ship(pages.sparkSession)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, small in batches:
            yield pd.Series([_paragraphs(t or "", min(800, size) if s else size, max(150, overlap) if s else overlap, least) for t, s in zip(texts, small, strict=True)])

    cut = F.pandas_udf(run, "array<string>")
    c = pages.select(key, cut(F.coalesce(F.col(text), F.lit("")), F.lit(False) if contract is None else F.coalesce(contract, F.lit(False))).alias("c"))
    return c.select(key, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "chunk")).withColumn("chunk_length", F.length("chunk"))


def stored_vectors(known: DataFrame, fresh: DataFrame, dimensions: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """known with fresh vectors added or put in place of those with their keys; vectors of other dimensions are refused."""
    ok = fresh.filter(F.size(embedding) == dimensions).dropDuplicates([key])
    return known.join(ok.select(key), key, "left_anti").unionByName(ok)


def removed_vectors(known: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    """known without the vectors of some keys."""
    return known.join(keys.select(key).distinct(), key, "left_anti")


def vector_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: vectors, least and greatest number of dimensions, and zero vectors."""
    n = F.size(embedding)
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.min(n).alias("least_dimensions"), F.max(n).alias("most_dimensions"), F.coalesce(F.sum(F.forall(embedding, lambda x: x == 0).cast("int")), F.lit(0)).alias("zeros"))
