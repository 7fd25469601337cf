"""Ranked lexical search: inverted treaps, one for each term and shard of documents, traversed together for the best of a query.

A term's postings are a binary tree that is a search tree by document and a heap by impact. Its root is what the term can add at most to
any document of the shard, and the root of what is left of it between two documents the most it can add to those between.

1. Count: documents with a term, and terms (N and L), which impacts depend on.
2. Index: shards of whole documents (SHARD_BYTES of text, SHARD_DOCS documents) are written to the shared folder, a row each: the terms'
   hashes, and their treaps in preorder: document, impact and size of the left subtree, 8 bytes a posting. All treaps of a shard are
   built at once, a level at a time.
3. Search: queries in blocks of about BLOCK_TERMS terms. A pass over the terms of all shards gives document frequencies; another finds
   each query's best. An interval of documents has, for each of the query's terms, the treap's subtree within it; the sum of the roots'
   scores is a bound for all of its documents. The best intervals are split at the document of their largest root, into what is before
   it, the document (its bound is its score), and what is after it; intervals whose bound is below the k-th best score so far go. A task
   keeps its k best from shard to shard, and the tasks' are ranked in Spark.

A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); its impact in a document where it occurs tf times is (10**9 tf) div
(1000 tf + 20 m), m = 50 + (50 n N) div L, n the document's terms; a score is the sum of weight times impact, in whole numbers.

Terms are runs of digits, letters and whatever is not ASCII, A-Z lower-cased; they are compared by 64-bit hashes.

Defined results: null and empty texts, of documents or queries, have no terms; a term counts once in a query; documents with a score of 0
are no result; equal scores rank by document id, without an id last; repeated documents are ranked one by one; queries that repeat id and
text are one; of queries that share an id each has its own ranks; without documents or queries there is no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import runtime
from tallyforge.llm.text import ALNUM, Words, mix, ragged, slices

SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 15
#: Terms of a block of queries; queries whose intervals a task holds at once; intervals that each of them splits in a step.
BLOCK_TERMS, TOGETHER, SPLIT = 1 << 18, 64, 16

_INDEX = "documents long, ids binary, named binary, terms binary, sizes binary, docs binary, impacts binary, lefts binary"
_LAST = np.iinfo(np.int64).max


def treaps(sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs, impacts and sizes of left subtrees in preorder, for many posting lists end to end, each sorted by document.

    Of equal impacts the root is chosen by a hash of the document, so a list of equal ones makes a balanced tree.
    """
    n = len(docs)
    places = np.arange(n, dtype=np.int64)
    key = (impacts.astype(np.int64) << 43) | ((mix(docs.astype(np.uint64) + np.uint64(1)) & np.uint64(0xFFFF)).astype(np.int64) << 27) | places
    at = np.empty(n, np.int64)
    left = np.empty(n, np.int64)
    low = np.cumsum(sizes) - sizes
    out, size = low.copy(), np.asarray(sizes, np.int64)
    live, start = key, low
    while len(live):
        root = np.maximum.reduceat(live, start) & ((1 << 27) - 1)
        before = root - low
        at[out], left[out] = root, before
        keep = np.ones(len(live), bool)
        keep[start + before] = False
        live = live[keep]
        low, out = np.stack([low, root + 1], 1).ravel(), np.stack([out + 1, out + 1 + before], 1).ravel()
        size = np.stack([before, size - before - 1], 1).ravel()
        some = size > 0
        low, out, size = low[some], out[some], size[some]
        start = np.cumsum(size) - size
    return docs[at], impacts[at], left


class _Building:
    """Documents of the shard that is being read: ids, terms of each, and hashes."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.bytes = 0

    def row(self) -> pa.RecordBatch:
        counts, hashes = np.concatenate(self.counts), np.concatenate(self.hashes)
        ids = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        named = np.array([i is not None for i in self.ids], np.uint8)
        order = np.lexsort((1 - named, ids))
        first = np.cumsum(counts) - counts
        hashes = hashes[ragged(first[order], counts[order])]
        ids, named, counts = ids[order], named[order], counts[order]
        m = 50 + (50 * counts * self.n_docs) // max(1, self.n_terms)
        doc = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(hashes, kind="stable")  # documents of a term stay in order
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(new)
        tf = np.diff(np.append(where, len(doc)))
        hashes, doc = hashes[where], doc[where]
        impact = (10**9 * tf) // (1000 * tf + 20 * m[doc])
        head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(head, len(doc)))
        d, i, left = treaps(sizes, doc, impact)
        columns = [ids.astype("<i8"), named, hashes[head].astype("<u8"), sizes.astype("<u4"), d.astype("<u2"), i.astype("<u4"), left.astype("<u2")]
        self.__init__(self.n_docs, self.n_terms)
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], schema=pa.schema([("documents", pa.int64()), *((c.split()[0], pa.binary()) for c in _INDEX.split(", ")[1:])]))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = m = 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                mark = ALNUM[data]
                begins = mark.copy()
                begins[1:] &= ~mark[:-1]
                inner = offs[1:-1][offs[1:-1] < len(data)]
                begins[inner] = mark[inner]
                terms = np.diff(np.concatenate([[0], np.cumsum(begins)])[offs])
                n += int((terms > 0).sum())
                m += int(terms.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m])], names=["n", "m"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, m long")
    total = rows.agg(F.sum("n"), F.sum("m")).first()
    return total[0] or 0, total[1] or 0


def index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each shard: its documents' ids and its terms' treaps, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Building(n_docs, n_terms)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offs in slices(batch.column("text")):
                words = Words(data, offs, ALNUM, lower=True)
                shard.ids += ids[lo:hi]
                shard.counts.append(np.diff(words.first))
                shard.hashes.append(words.hashes)
                shard.bytes += len(data)
                if shard.bytes >= SHARD_BYTES or len(shard.ids) + runtime.BATCH_ROWS > SHARD_DOCS:
                    yield shard.row()
        if shard.ids:
            yield shard.row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return runtime.stored(rows.mapInArrow(run, _INDEX), "treaps", **{"parquet.block.size": str(16 << 20)})


class _Shard:
    def __init__(self, row: dict):
        self.ids, self.named = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["named"], np.uint8).astype(bool)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.docs, self.impacts, self.lefts = (np.frombuffer(row[c], k).astype(np.int32) for c, k in (("docs", "<u2"), ("impacts", "<u4"), ("lefts", "<u2")))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def narrow(self, node: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Each subtree (its root, how many nodes) becomes the one of its nodes within low <= document < high; none: size 0."""
        live = np.flatnonzero(size > 0)
        while len(live):
            p = node[live]
            d = self.docs[p]
            right = d < low[live]
            move = right | (d >= high[live])
            live, p, right = live[move], p[move], right[move]
            left = self.lefts[p]
            node[live] = np.where(right, p + 1 + left, p + 1)
            size[live] = np.where(right, size[live] - 1 - left, left)
            live = live[size[live] > 0]


class _Best:
    """The k best of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.named = np.zeros(0, bool)
        self.least = np.ones(queries, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        some = score >= self.least[query]
        if not some.any():
            return
        query, score, doc, named = (np.concatenate(c) for c in ((self.query, query[some]), (self.score, score[some]), (self.doc, doc[some]), (self.named, named[some])))
        order = np.lexsort((~named, doc, -score, query))
        query, score, doc, named = query[order], score[order], doc[order], named[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        keep = place < self.k
        self.query, self.score, self.doc, self.named = query[keep], score[keep], doc[keep], named[keep]
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(score[last], 1)


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by sorted owner, exact."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edge = np.searchsorted(owner, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def traverse(shard: _Shard, query: np.ndarray, term: np.ndarray, weight: np.ndarray, best: _Best) -> int:
    """Adds to best what the shard has for queries: sorted numbers, one for each of their terms, with place in the shard and weight. Intervals split are returned."""
    names, first = np.unique(query, return_index=True)
    # Intervals: query, from, to, bound, and where their subtrees begin and end in the arrays of subtrees.
    q, low, high = names, np.zeros(len(names), np.int32), np.full(len(names), len(shard.ids), np.int32)
    node, size, w = shard.starts[term].astype(np.int32), shard.sizes[term].astype(np.int32), weight.astype(np.int64)
    begin, end = first.astype(np.int64), np.append(first[1:], len(query)).astype(np.int64)
    bound = np.add.reduceat(w * shard.impacts[node], begin)
    steps = 0
    while len(q):
        live = bound >= best.least[q]
        q, low, high, bound, begin, end = (x[live] for x in (q, low, high, bound, begin, end))
        if not len(q):
            break
        order = np.lexsort((-bound, q))
        now = np.zeros(len(q), bool)
        now[order[np.arange(len(q)) - np.searchsorted(q[order], q[order], "left") < SPLIT]] = True
        steps += int(now.sum())
        pick, count = ragged(begin[now], (end - begin)[now]), (end - begin)[now]
        own = np.repeat(np.arange(len(count)), count)
        p, s, v = node[pick], size[pick], w[pick]
        key = (v * shard.impacts[p] << 27) | np.arange(len(p))
        top = np.maximum.reduceat(key, np.cumsum(count) - count) & ((1 << 27) - 1)
        d = shard.docs[p[top]]
        here, there, left = shard.docs[p], d[own], shard.lefts[p]
        down = np.stack([p + 1, p + 1 + left]), np.stack([left, s - 1 - left])
        before, after, same = here < there, here > there, here == there
        nodes = np.concatenate([np.where(before, p, down[0][0]), np.where(same, p, np.where(before, down[0][1], down[0][0])), np.where(after, p, down[0][1])]).astype(np.int32)
        sizes = np.concatenate([np.where(before, s, down[1][0]), np.where(same, 1, np.where(before, down[1][1], down[1][0])), np.where(after, s, down[1][1])]).astype(np.int32)
        lows, highs = np.concatenate([low[now], d, d + 1]), np.concatenate([d, d + 1, high[now]])
        n = len(d)
        owner = np.concatenate([own, own + n, own + 2 * n])
        shard.narrow(nodes, sizes, lows[owner], highs[owner])
        some = sizes > 0
        nodes, sizes, owner, v = nodes[some], sizes[some], owner[some], np.tile(v, 3)[some]
        bounds, queries = _sums(v * shard.impacts[nodes], owner, 3 * n), np.tile(q[now], 3)
        best.add(queries[n : 2 * n], bounds[n : 2 * n], shard.ids[d], shard.named[d])
        # Open intervals: those that were not split, and the new ones, with their subtrees.
        rest = ~now
        kept, c = ragged(begin[rest], (end - begin)[rest]), (end - begin)[rest]
        going = bounds >= best.least[queries]
        going[n : 2 * n] = False
        sub = going[owner]
        counts = np.bincount(owner[sub], minlength=3 * n)[going]
        node, size, w = np.concatenate([node[kept], nodes[sub]]), np.concatenate([size[kept], sizes[sub]]), np.concatenate([w[kept], v[sub]])
        q, low, high, bound = (np.concatenate([x[rest], y[going]]) for x, y in ((q, queries), (low, lows), (high, highs), (bound, bounds)))
        c = np.concatenate([c, counts])
        end = np.cumsum(c)
        begin = end - c
    return steps


def _hashed(queries: DataFrame, key: str) -> DataFrame:
    """q, key, n, terms: the distinct terms' hashes of every query that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offs in slices(batch.column("text")):
                words = Words(data, offs, ALNUM, lower=True)
                found += [np.unique(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["key", "n", "terms"])

    rows = queries.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).distinct()
    kind = rows.schema["key"].dataType.simpleString()
    return runtime.stored(rows.mapInArrow(run, f"key {kind}, n long, terms binary").filter("n > 0").withColumn("q", F.monotonically_increasing_id()), "queries")


def search(docs: DataFrame, queries: DataFrame, limit: int = 50, key: str = "item_id") -> DataFrame:
    """key, rank, doc_id, score: the `limit` best documents of each query, best first."""
    runtime.prepare(docs.sparkSession)
    n_docs, n_terms = totals(docs)
    shards = index(docs, n_docs, n_terms)
    asked = _hashed(queries, key)
    total = asked.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "terms").collect()  # about BLOCK_TERMS terms
        some = runtime.stored(_searched(shards, rows, n_docs, limit), "found")
        found = some if found is None else found.unionByName(some)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "task"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= limit)
    runtime.drop(shards)
    return ranked.join(asked.select("q", F.col("key").alias(key)), "q").select(key, "rank", "doc_id", "score")


def _searched(shards: DataFrame, rows: list, n_docs: int, limit: int) -> DataFrame:
    """q, doc_id, score, task: of each query the best of every task."""
    names = np.array([r[0] for r in rows], np.int64)
    hashes = [np.frombuffer(r[1], "<u8") for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    every, term = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.uint64), return_inverse=True)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(every), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                have, n = np.frombuffer(terms, "<u8"), np.frombuffer(sizes, "<u4")
                if len(have):
                    at = np.minimum(np.searchsorted(have, every), len(have) - 1)
                    total += np.where(have[at] == every, n[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["t", "n"])

    df = np.zeros(len(every), np.int64)
    for t, n in shards.select("terms", "sizes").mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n")).collect():  # a row for each term of the block at most
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    useful = (df[term] > 0) & (weight[term] > 0)
    owner, term = owner[useful], term[useful]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(names), limit)
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row)
                at = shard.find(every)
                for lo in range(0, len(names), TOGETHER):
                    a, b = np.searchsorted(owner, [lo, lo + TOGETHER])
                    here = a + np.flatnonzero(at[term[a:b]] >= 0)
                    if len(here):
                        traverse(shard, owner[here], at[term[here]], weight[term[here]], best)
        ids = pa.array(best.doc, pa.int64(), mask=~best.named)
        yield pa.RecordBatch.from_arrays([pa.array(names[best.query], pa.int64()), ids, pa.array(best.score)], names=["q", "doc_id", "score"])

    columns = ("ids", "named", "terms", "sizes", "docs", "impacts", "lefts")
    return shards.select(*columns).mapInArrow(run, "q long, doc_id long, score long").withColumn("task", F.monotonically_increasing_id())
