"""Packing of documents into training sequences: order-preserving dynamic programming over window cuts.

Each input partition is a stream of documents in its own order; no shuffle is needed and none takes place. A window is a run of at
most `length` tokens of the stream. Cuts stand between documents (free), after a sentence (SENTENCE) or, where neither comes for
STRIDE tokens (or a quarter of `length`), anywhere (ANYWHERE). The chosen cuts minimise the sum over windows of WINDOW, padding and penalty, where a window
whose length is a power of two needs no padding:

    best[j] = penalty[j] + min(best[i] + WINDOW + padding(at[j] - at[i]))   over i with at[j] - at[i] <= length

Padding is linear in at[i], so the minimum over a sliding range of i comes from a monotone queue of best[i] + at[i]; windows of a
power of two are extra transitions. Streams are solved BLOCK tokens at a time and the last, unfinished window is carried on, so a
task's memory doesn't grow with its partition. What is left at the end of a partition is split into powers of two if that is cheaper
than its padding.

Defined results: a null or empty text is a document of only the end token; repeated rows are packed as often as they come; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime
from tallyforge.llm.text import slices

WINDOW, SENTENCE, ANYWHERE, STRIDE = 32, 4, 64, 256
#: Tokens solved at once.
BLOCK = 1 << 18

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_tokens long"
)


def padded(n: int, length: int) -> int:
    """What a sequence of n tokens takes with its padding."""
    return n if n & (n - 1) == 0 else length


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int, final: bool) -> list[int]:
    """Indices of the chosen cuts, 0 first. at: positions, rising from 0 in steps of at most length; the last is only a cut if final."""
    n = len(at)
    where = np.full(int(at[-1]) + 1, -1, np.int64)
    where[at] = np.arange(n)
    pairs_to, pairs_from = [], []
    size = 64
    while size < length:
        to = np.flatnonzero(at >= size)
        back = where[at[to] - size]
        ok = back >= 0
        pairs_to.append(to[ok])
        pairs_from.append(back[ok])
        size *= 2
    pairs_to, pairs_from = np.concatenate(pairs_to or [np.zeros(0, np.int64)]), np.concatenate(pairs_from or [np.zeros(0, np.int64)])
    order = np.argsort(pairs_to, kind="stable")
    pairs_to, pairs_from = [*pairs_to[order].tolist(), n], [*pairs_from[order].tolist(), 0]
    at_, cost = at.tolist(), penalty.tolist()
    best, came = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best[i] + at[i], i), rising in both
    pop, push, popleft = queue.pop, queue.append, queue.popleft
    k, linear = 0, WINDOW + length
    for j in range(1, n):
        here = at_[j]
        while at_[queue[0][1]] < here - length:
            popleft()
        key, i = queue[0]
        low = key + linear - here
        while pairs_to[k] == j:
            x = best[pairs_from[k]] + WINDOW
            if x < low:
                low, i = x, pairs_from[k]
            k += 1
        low += cost[j]
        best[j], came[j] = low, i
        key = low + here
        while queue and queue[-1][0] >= key:
            pop()
        push((key, j))
    j = n - 1
    if not final:  # the cheapest place to stop among the last windows; what comes after it is carried on
        near = int(np.searchsorted(at, at[-1] - length))
        j = min(range(max(near, 1), n), key=lambda x: (best[x], -x))
    out = [j]
    while j:
        j = came[j]
        out.append(j)
    return out[::-1]


def sentence_ends(tokenizer) -> np.ndarray:
    """A mask over token ids: those that are only closing punctuation and hold one of . ! ?"""
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        text = token.removesuffix("</w>")
        out[i] = bool(text) and set(text) <= set(".!?\"')]") and bool(set(text) & set(".!?"))
    return out


class _Packer:
    """One partition's stream."""

    def __init__(self, ends: np.ndarray, length: int, partition: int):
        self.ends, self.length, self.sequence = ends, length, partition << 33
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple] = []  # (doc id, its tokens, position of its first token here, may be below 0)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((doc_id, len(ids), self.n))
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK:
            yield self.flush(False)

    def flush(self, final: bool) -> list[tuple]:
        ids = self.ids = np.concatenate([self.ids, *self.waiting]) if self.waiting else self.ids
        self.waiting, n, length = [], len(ids), self.length
        if not n:
            return []
        if n == 1 or n <= length and final:
            cuts = np.array([0, n])
        else:
            penalty = np.full(n + 1, -1, np.int64)
            penalty[1:][self.ends[ids]] = SENTENCE
            for _, _, first in self.docs:
                if first >= 0:
                    penalty[first] = 0
            penalty[0] = penalty[n] = 0
            at = np.flatnonzero(penalty >= 0)
            stride = min(STRIDE, max(1, length // 4))
            wide = np.flatnonzero(np.diff(at) > stride)
            if len(wide):
                more = np.concatenate([np.arange(at[g] + stride, at[g + 1], stride) for g in wide.tolist()])
                penalty[more] = ANYWHERE
                at = np.flatnonzero(penalty >= 0)
            cuts = at[best_cuts(at, penalty[at], length, final)]
        if final:
            last, pieces = int(cuts[-1] - cuts[-2]), bin(int(cuts[-1] - cuts[-2])).count("1")
            if pieces > 1 and length - last > (pieces - 1) * (WINDOW + ANYWHERE):
                powers = [1 << b for b in range(last.bit_length() - 1, -1, -1) if last >> b & 1]
                cuts = np.concatenate([cuts[:-2], cuts[-2] + np.cumsum([0, *powers])])
        done = int(cuts[-1])
        out = self.pieces(cuts)
        self.ids, self.n = ids[done:].copy(), n - done
        self.docs = [(d, m, first - done) for d, m, first in self.docs if first + m > done]
        return out

    def pieces(self, cuts: np.ndarray) -> list[tuple]:
        out, k, cuts, bytes_ = [], 0, cuts.tolist(), memoryview(self.ids.astype("<u4", copy=False)).cast("B")
        for doc_id, m, first in self.docs:
            a, end = max(first, 0), min(first + m, cuts[-1])
            while a < end:
                while cuts[k + 1] <= a:
                    k += 1
                b, size = min(end, cuts[k + 1]), cuts[k + 1] - cuts[k]
                out.append((doc_id, a - first, b - a, zlib.crc32(bytes_[4 * a : 4 * b]), m, self.sequence + k, a - cuts[k], size, padded(size, self.length)))
                a = b
        self.sequence += len(cuts) - 1
        return out


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """A row for each piece of a document: where it stands in its document and in which sequence. See the module for the method.

    docs: doc_id, text. tokenizer: path of a word-level BPE file, the same on every executor. Every id, end_id included, lies in
    exactly one piece; pieces of a sequence follow each other without gaps. padded_tokens: the sequence's size with its padding.
    """
    runtime.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.tokens import WordEncoder

        encoder = WordEncoder(tokenizer)
        packer = _Packer(sentence_ends(encoder.tokenizer), length, TaskContext.get().partitionId())
        rows: list[tuple] = []
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, data, offs in slices(batch.column(1)):
                ids, at = encoder.encode(data, offs)
                for i in range(lo, hi):
                    one = np.append(ids[at[i - lo] : at[i - lo + 1]], np.uint32(end_id))
                    for got in packer.add(doc_ids[i], one):
                        rows += got
                if len(rows) > 10_000:
                    yield _batch(rows)
                    rows = []
        rows += packer.flush(True)
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)
