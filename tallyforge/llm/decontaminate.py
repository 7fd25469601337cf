"""Benchmark decontamination: suffix arrays of training shards, searched for every suffix of every test item.

A shard is a run of whole documents of about SHARD_BYTES. Its suffix array orders the words' positions by the words that follow
(as 64-bit hashes), up to the length of the longest test item: ranks by one word, then by doubling, where each round sorts only the
positions that are still tied. A binary search of each test suffix gives the range of positions where its first `window` words occur
verbatim, all of them, and from the ends of that range its longest match.

The test items' words are hashed in Spark tasks and written to the shared folder. If they have at most BLOCK_WORDS words, which is
checked, they are sent to the tasks, and shards are searched where they are read: no shuffle. Otherwise items are dealt into blocks of
about that size; documents are dealt into shards, and each shard's task gets its documents first and then one block after another, so it
holds one shard and one block however large either table is. Either way there is one pass over the documents, and the driver holds at
most one block.

Words: A-Z lower-cased, runs of digits, letters and whatever is not ASCII. A window: `window` consecutive words of an item; an item of
fewer, but not none, is one window.

Defined results: a null or empty text has no words and is never hit; an item without words never occurs; item ids that repeat count
once; an item without an id hits words like others, but is not counted or named among the items; repeated documents are judged alike;
without items nothing is hit; other columns are kept by `decontaminate` and not read by `overlaps`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime
from tallyforge.llm.text import ALNUM, Words, slices

WINDOW = 10
#: Words of a block of test items, at 8 bytes each; bytes of a shard's texts.
BLOCK_WORDS, SHARD_BYTES = 1 << 20, 4 << 20


class Items:
    """A block of test items: ids, word hashes end to end, first[i]: words before item i."""

    def __init__(self, ids: list[str | None], hashes: list[bytes]):
        self.ids = ids
        self.hashes = np.frombuffer(b"".join(hashes), np.uint64)
        self.first = np.concatenate([[0], np.cumsum([len(h) // 8 for h in hashes])]).astype(np.int64)
        self.longest = int(np.diff(self.first).max(initial=0))

    def suffixes(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, width and item of every window, which is the head of the suffix that starts there."""
        size = np.diff(self.first)
        count = np.where(size >= window, size - window + 1, np.minimum(size, 1))
        item = np.repeat(np.arange(len(size)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + self.first[:-1][item]
        return start, np.minimum(size, window)[item], item


def hashed(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), hashes (8 bytes a word) of every item with words, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                words = Words(data, offs, ALNUM, lower=True)
                cuts = words.first.tolist()
                packed = [words.hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.array(packed, pa.binary())], names=["item_id", "n", "hashes"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return runtime.stored(rows.mapInArrow(run, "item_id string, n long, hashes binary").filter("n > 0"), "items")


class SuffixArray:
    """Positions of a shard's words in order of what follows them, as far as `depth` words. A separator, 0, ends each document."""

    def __init__(self, words: Words, depth: int):
        n, docs = len(words), len(words.first) - 1
        doc = np.repeat(np.arange(docs), np.diff(words.first))
        self.start = words.first + np.arange(docs + 1)  # of each document, in self.words
        self.words = np.zeros(n + docs + 1, np.uint64)
        self.words[np.arange(n) + doc] = np.maximum(words.hashes, np.uint64(1))
        size = len(self.words)
        sa = np.argsort(self.words, kind="stable")
        self.order = sa
        rank = np.empty(size, np.int64)
        starts = self._groups(self.words[sa])
        rank[sa] = np.repeat(starts, np.diff(np.append(starts, size)))
        left = np.repeat(np.append(self.start[1:], size), np.diff(np.append(self.start, size)))  # where each position's document ends
        slot = np.flatnonzero(self._tied(starts, size))
        d = 1
        while d < depth and len(slot):
            at = sa[slot]
            go = at + d < left[at]  # beyond its document a suffix can't match, so ties there may stay
            slot, at = slot[go], at[go]
            if not len(at):
                break
            key = rank[at] * np.int64(size + 1) + rank[at + d]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            sa[slot] = at
            new = self._groups(key)
            span = np.diff(np.append(new, len(key)))
            rank[at] = np.repeat(slot[new], span)
            slot = slot[np.repeat(span > 1, span)]
            d *= 2

    @staticmethod
    def _groups(values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)

    @staticmethod
    def _tied(starts: np.ndarray, size: int) -> np.ndarray:
        span = np.diff(np.append(starts, size))
        return np.repeat(span > 1, span)

    def _bound(self, query: np.ndarray, start: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
        """For each query, query[start : start + width]: the first place in the order that isn't before it, or (after) that is past all that begin with it."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.order))
        words, order, last = self.words, self.order, len(self.words) - 1
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at, q, w = order[mid], start[open_], width[open_]
            down, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)  # the place is before the query; begins with it
            for t in range(int(w.max())):
                same = np.flatnonzero(equal & (w > t))
                if not len(same):
                    break
                a, b = words[np.minimum(at[same] + t, last)], query[q[same] + t]
                down[same[a < b]] = True
                equal[same[a != b]] = False
            if after:
                down |= equal
            lo[open_[down]] = mid[down] + 1
            hi[open_[~down]] = mid[~down]

    def find(self, query: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the order whose suffixes begin with query[start : start + width]."""
        lo = self._bound(query, start, width, False)
        hi = lo.copy()
        near = np.flatnonzero(lo < len(self.order))
        first = self.words[self.order[lo[near]]] == query[start[near]]
        near = near[first]
        hi[near] = self._bound(query, start[near], width[near], True)
        return lo, hi

    def lengths(self, at: np.ndarray, query: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words at each position agree with those from query[start], `most` at most."""
        out, same, last = np.zeros(len(at), np.int64), np.arange(len(at)), len(self.words) - 1
        t = 0
        while len(same := same[most[same] > t]):
            same = same[self.words[np.minimum(at[same] + t, last)] == query[start[same] + t]]
            out[same] += 1
            t += 1
        return out


class Found:
    """What a shard's documents share with test items, block after block."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words = Words(data, offs, ALNUM, lower=True)
        docs = len(offs) - 1
        self.hit = np.zeros(len(self.words), bool)
        self.names: list[set[str]] = [set() for _ in range(docs)]
        self.longest, self.at = np.zeros(docs, np.int64), np.full(docs, -1)  # words of the longest match, and the first word of the first such
        self.array, self.depth = None, 0

    def search(self, items: Items, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each test suffix whose window occurs: its item, its offset there, and the places: documents, words in them, lengths of the matches."""
        start, width, item = items.suffixes(window)
        if not len(self.words) or not len(start):
            return
        if self.depth < items.longest:
            self.array, self.depth = SuffixArray(self.words, items.longest), items.longest
        lo, hi = self.array.find(items.hashes, start, width)
        for k in np.flatnonzero(lo < hi).tolist():  # each window's places are taken together
            at = self.array.order[lo[k] : hi[k]]
            doc = np.searchsorted(self.array.start, at, "right") - 1
            rest = np.full(len(at), items.first[item[k] + 1] - start[k])
            length = self.array.lengths(at, items.hashes, np.full(len(at), start[k]), rest)
            yield int(item[k]), int(start[k] - items.first[item[k]]), doc, at - doc - self.words.first[doc], length

    def add(self, items: Items, window: int) -> None:
        cover = np.zeros(len(self.words) + 1, np.int64)
        for item, _, doc, word, length in self.search(items, window):
            flat = word + self.words.first[doc]
            np.add.at(cover, flat, 1)
            np.add.at(cover, flat + np.minimum(length, window), -1)
            if items.ids[item] is not None:
                for d in np.unique(doc).tolist():
                    self.names[d].add(items.ids[item])
            order = np.lexsort((-word, length))  # the longest, of those the first, comes last
            best = np.full(len(self.longest), -1)
            best[doc[order]] = order
            some = np.flatnonzero(best >= 0)
            new, word = length[best[some]], word[best[some]]
            more = (new > self.longest[some]) | ((new == self.longest[some]) & (word < self.at[some]))
            self.longest[some[more]], self.at[some[more]] = new[more], word[more]
        self.hit |= np.cumsum(cover[:-1]) > 0


OVERLAPS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_word long"


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text): how many of its words lie in a window of benchmark (item_id, text), and of which items.

    longest_match: words of the longest verbatim match with an item that begins with a window; match_word: words before the first such
    (null without one).
    """
    return _searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, _measures, OVERLAPS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that share no window with the benchmark."""
    return _searched(docs, benchmark, window, _clean, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """For each test suffix (item_id, offset in words) with a verbatim match of `least` words or more: the longest one's length, and where it is: doc_id and word.

    Of equal lengths, that in the smallest doc_id, then the first. Each shard reports its best for a suffix, and those are compared.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = _searched(rows, benchmark, least, None, "item_id string, offset long, length long, doc_id long, word long")
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "word")).alias("b")
    return every.groupBy("item_id", "offset").agg(best).select("item_id", "offset", (-F.col("b.l")).alias("length"), "b.doc_id", "b.word")


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, result, schema) -> DataFrame:
    """result(rows, Found) of every shard; without a result, the best place of each test suffix in it."""
    spark = runtime.prepare(docs.sparkSession)
    items, text = hashed(benchmark), docs.columns.index("text")
    total = items.agg(F.sum("n")).first()[0] or 0
    if total <= BLOCK_WORDS:
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.select("item_id", "hashes").collect()])  # at most BLOCK_WORDS words
        runtime.drop(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items([k for k, _ in sent.value], [bytes(h) for _, h in sent.value])
            for batch in batches:
                for lo, hi, data, offs in slices(batch.column(text), SHARD_BYTES):
                    yield from _judged(batch.slice(lo, hi - lo), data, offs, [block], window, result)

        return docs.mapInArrow(run, schema)

    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    shards, n_blocks = max(1, -(-size // SHARD_BYTES)), -(-total // BLOCK_WORDS)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), F.lit(-1).cast("long").alias("block"), F.struct("*").alias("doc"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("binary").alias("hashes"))
    some = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(4096))).alias("from"))
    every = some.select("*", F.explode(F.sequence("from", F.least(F.col("from") + 4095, F.lit(shards - 1)))).alias("shard"))
    parts = every.select(F.col("shard").cast("long").alias("shard"), F.pmod(F.xxhash64("hashes"), F.lit(n_blocks)).alias("block"), F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"), "item_id", "hashes")
    mixed = rows.unionByName(parts).repartition("shard").sortWithinPartitions("shard", "block")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            column = shard.docs.column(text)
            (_, _, data, offs), *_ = slices(column, 1 << 62)
            yield from _judged(shard.docs, data, offs, shard.blocks(), window, result)

    return mixed.mapInArrow(stream, schema)


class _Shard:
    """Rows of one shard as they come: its documents, then its blocks of items."""

    def __init__(self, docs: pa.RecordBatch, ahead: list, rows: Iterator[tuple]):
        self.docs, self._ahead, self._rows, self._key = docs, ahead, rows, ahead[0][0] if ahead else None

    def blocks(self) -> Iterator[Items]:
        """Each block; reading all of them leaves the next shard's first row in `ahead`."""
        block, ids, hashes = None, [], []
        for row in self._take():
            if row[1] != block:
                if ids:
                    yield Items(ids, hashes)
                block, ids, hashes = row[1], [], []
            ids.append(row[3])
            hashes.append(row[4])
        if ids:
            yield Items(ids, hashes)

    def _take(self) -> Iterator[tuple]:
        while self._ahead and self._ahead[0][0] == self._key and self._ahead[0][1] >= 0:
            row = self._ahead.pop()
            nxt = next(self._rows, None)
            if nxt is not None:
                self._ahead.append(nxt)
            yield row


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            shard, block, ids = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for i in range(batch.num_rows):
                yield shard[i], block[i], batch.slice(i, 1), ids[i], batch.column(4)[i].as_py() if block[i] >= 0 else None

    it = rows()
    first = next(it, None)
    ahead = [first] if first is not None else []
    while ahead:
        key, docs = ahead[0][0], []
        while ahead and ahead[0][:2] == (key, -1):
            docs.append(ahead.pop()[2])
            if (nxt := next(it, None)) is not None:
                ahead.append(nxt)
        if docs:
            table = pa.Table.from_batches(docs).combine_chunks()
            shard = _Shard(pa.RecordBatch.from_struct_array(table["doc"].chunk(0)), ahead, it)
            shard._key = key
            yield shard
        while ahead and ahead[0][0] == key:  # blocks of a shard without documents, or that nobody read
            ahead.pop()
            if (nxt := next(it, None)) is not None:
                ahead.append(nxt)


def _judged(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, blocks: list[Items] | Iterator[Items], window: int, result) -> Iterator[pa.RecordBatch]:
    found = Found(data, offs)
    for items in blocks:
        if result:
            found.add(items, window)
        else:
            yield from _best(rows.column(0), found, items, window)
    if result:
        yield result(rows, found)


def _best(column: pa.Array, found: Found, items: Items, window: int) -> Iterator[pa.RecordBatch]:
    out = []
    ids, none = column.fill_null(0).to_numpy(), np.asarray(column.is_null())  # whole numbers throughout; those without an id are last
    for item, offset, doc, word, length in found.search(items, window):
        if length.max() >= window:
            k = np.lexsort((word, ids[doc], none[doc], -length))[0]
            out.append((items.ids[item], offset, int(length[k]), None if none[doc[k]] else int(ids[doc[k]]), int(word[k])))
    if out:
        kinds = (pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["item_id", "offset", "length", "doc_id", "word"])


def _measures(rows: pa.RecordBatch, found: Found) -> pa.RecordBatch:
    first = found.words.first
    sums = np.concatenate([[0], np.cumsum(found.hit)])
    n_hit = sums[first[1:]] - sums[first[:-1]]
    names = [sorted(x) for x in found.names]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _EMPTY for x in names]
    columns = [rows.column(0), pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(sha), pa.array(n_hit > 0), pa.array(found.longest), pa.array(found.at, mask=found.at < 0)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OVERLAPS.split(", ")])


def _clean(rows: pa.RecordBatch, found: Found) -> pa.RecordBatch:
    return rows.filter(pa.array(found.longest == 0))


_EMPTY = hashlib.sha256(b"").hexdigest()
