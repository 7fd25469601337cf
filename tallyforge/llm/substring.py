"""Substring dedup by fixed-block anchors: exact repeats of `window` words or more, within and across documents.

A window covers at least one whole block of (window + 1) // 2 words that begins at a multiple of that length in its document. So:

1. Index and probe: the hashes of all rolling runs of a block's length are dealt out by hash, marked where they are aligned blocks. A
   hash with an aligned block and a second occurrence is an anchor.
2. Extension: around each anchor, the hashes of the windows that hold it are dealt out in the same way. Those that occur twice are
   repeats; overlapping ones join to maximal exact repeats, and their words go.

Documents are read in groups of about GROUP_BYTES of text. A group sends each distinct hash once, with a mark if the group has it more
often, so a passage that a third of all documents share is one entry from each group, not one from each document. Hashes travel as
packed arrays of one group and one range, not as rows. Anchors only propose: a false one costs time. Windows are compared by two
hashes of their words' hashes, of 62 bits and their range and of 64 bits: among 10**13 windows no two different ones are expected to agree.

Defined results: a null, empty or blank text has no words and an empty digest; texts shorter than a window keep all words; of repeated
documents every copy loses its repeated words; repeated rows count as occurrences of each other; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime
from tallyforge.llm.text import NOT_SPACE, Words, ragged, slices, window_hashes

GROUP_BYTES = 6 << 20

_HASHES = "range long, grp long, hashes binary"
#: How hashes travel: of blocks in 32 bits, of windows in two numbers; the two lowest bits of the first are marks.
_SHORT, _LONG = np.dtype([("a", "<u4")]), np.dtype([("a", "<u8"), ("b", "<u8")])


def _text_words(table: pa.Table) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offs in slices(table["text"], 1 << 40):
        yield lo, hi, Words(data, offs, NOT_SPACE)


def _inside(words: Words, width: int) -> np.ndarray:
    """Of every run of `width` words: whether it lies within one text."""
    n = max(0, len(words) - width + 1)
    last = np.repeat(words.first[1:] - width, np.diff(words.first))[:n]
    return np.arange(n) <= last


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _dealt(hashes: np.ndarray, aligned: np.ndarray, group: int, ranges: int, other: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each range: the group's distinct hashes in it, with two low bits: found more than once, found aligned.

    Of hashes alone: 30 bits of what the range leaves open. With other hashes beside them: 62 bits, and those.
    """
    if not len(hashes):
        return
    kind = _SHORT if other is None else _LONG
    bits = np.uint64(30 if other is None else 62)
    at = (hashes % np.uint64(ranges)).astype(np.int64)
    value = (hashes // np.uint64(ranges)) & ((np.uint64(1) << bits) - np.uint64(1))
    columns = [value, at] if other is None else [other, value, at]
    by = np.lexsort(columns)
    columns = [c[by] for c in columns]
    value, at, aligned = columns[-2], columns[-1], aligned[by]
    first = _starts(*columns)
    count = np.diff(np.append(first, len(at)))
    some = np.maximum.reduceat(aligned, first).astype(np.uint64)
    packed = np.empty(len(first), kind)
    packed["a"] = value[first] << np.uint64(2) | (count > 1).astype(np.uint64) << np.uint64(1) | some
    if other is not None:
        packed["b"] = columns[0][first]
    at = at[first]
    cuts = _starts(at)
    parts = [packed[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(at[cuts], pa.int64()), pa.array(np.full(len(cuts), group), pa.int64()), pa.array(parts, pa.binary())], names=["range", "grp", "hashes"])


def _packed(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, pa.schema([("range", pa.int64()), ("grp", pa.int64()), ("hashes", pa.binary())]))


def _repeated(kind: np.dtype, anchors: bool) -> Callable:
    """From rows of one range after another: for each group its hashes that occur twice (and, for anchors, aligned at least once)."""

    def judge(at: int, groups: list[int], parts: list[bytes]) -> pa.RecordBatch:
        size = np.array([len(p) for p in parts]) // kind.itemsize
        packed = np.frombuffer(b"".join(parts), kind).copy()
        flags = packed["a"] & packed["a"].dtype.type(3)
        packed["a"] >>= packed["a"].dtype.type(2)
        by = np.lexsort([packed[c] for c in kind.names[::-1]])
        first = _starts(*(packed[c][by] for c in kind.names))
        count = np.diff(np.append(first, len(by)))
        flags = np.bitwise_or.reduceat(flags[by], first)
        hit = (count > 1) | (flags & 2 > 0)
        if anchors:
            hit &= flags & 1 > 0
        found = np.zeros(len(packed), bool)
        found[by] = np.repeat(hit, count)
        kept = [(g, packed[a:b][found[a:b]]) for g, a, b in zip(groups, (np.cumsum(size) - size).tolist(), np.cumsum(size).tolist(), strict=True)]
        kept = [(g, v.tobytes()) for g, v in kept if len(v)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), at), pa.int64()), pa.array([g for g, _ in kept], pa.int64()), pa.array([v for _, v in kept], pa.binary())], names=["range", "grp", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups, parts = None, [], []
        for batch in batches:
            for r, g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    if parts:
                        yield judge(at, groups, parts)
                    at, groups, parts = r, [], []
                groups.append(g)
                parts.append(h)
        if parts:
            yield judge(at, groups, parts)

    return run


class _Found:
    """A group's replies: which hashes were found."""

    def __init__(self, table: pa.Table, ranges: int, kind: np.dtype):
        self.ranges, self.bits = np.uint64(ranges), np.uint64(30 if kind == _SHORT else 62)
        rows = sorted(zip(table["range"].to_pylist(), table["hashes"].to_pylist(), strict=True))
        size = [len(h) // kind.itemsize for _, h in rows]
        packed = np.frombuffer(b"".join(h for _, h in rows), kind)
        key = self._key(np.repeat(np.array([r for r, _ in rows], np.uint64), size), packed["a"].astype(np.uint64))
        other = np.zeros(len(key), np.uint64) if kind == _SHORT else packed["b"]
        by = np.lexsort((other, key))
        self.hashes, self.other = key[by], other[by]

    def _key(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        # Ranges and values together may exceed 64 bits only where values have 62; there what the range leaves open has fewer.
        return value * self.ranges + at

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the first hash was found."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        value = (hashes // self.ranges) & ((np.uint64(1) << self.bits) - np.uint64(1))
        self.sought = self._key(hashes % self.ranges, value)
        self.at = np.searchsorted(self.hashes, self.sought)
        return self.hashes[np.minimum(self.at, len(self.hashes) - 1)] == self.sought

    def has_both(self, hashes: np.ndarray, other: Callable[[], np.ndarray]) -> np.ndarray:
        """Whether both hashes were found together; other() is only asked for if a first one was."""
        found = self.has(hashes)
        if not found.any():
            return found
        some = np.flatnonzero(found)
        want, at, key = other()[some], self.at[some], self.sought[some]
        good = np.zeros(len(some), bool)
        left = np.arange(len(some))
        while len(left):  # those whose entry has another second hash go on to the next entry with the first; as a rule there is none
            good[left] = self.other[at[left]] == want[left]
            left = left[~good[left]]
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == key[left]]
        found[some] = good
        return found


def repeats(docs: DataFrame, window: int = 35, texts: bool = False) -> DataFrame:
    """For each row of doc_id, text: n_words, n_removed, kept_sha256 (of the kept words joined by spaces) and spans, the maximal repeats as (start, end) in words.

    Words are runs without ASCII white space, unchanged. texts: add kept, the kept words joined by spaces.
    """
    spark = runtime.prepare(docs.sparkSession)
    block = (window + 1) // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(4, -(-total // GROUP_BYTES))
    ranges = groups  # so a range gets about as many hashes as a group has words
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for _, _, words in _text_words(table):
            ok = _inside(words, block)
            place = np.arange(len(ok)) - np.repeat(words.first[:-1], np.diff(words.first))[: len(ok)]
            out += _dealt(window_hashes(words.hashes, block)[ok], (place % block == 0)[ok], key[0].as_py(), ranges)
        return _packed(out)

    def settled(dealt: DataFrame, kind: np.dtype, anchors: bool, name: str) -> DataFrame:
        by_range = dealt.repartition("range").sortWithinPartitions("range")
        return runtime.stored(by_range.mapInArrow(_repeated(kind, anchors), _HASHES), name)

    anchors = settled(grouped.groupBy("grp").applyInArrow(probe, _HASHES), _SHORT, True, "anchors")

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        out, found = [], _Found(replies, ranges, _SHORT)
        if len(found.hashes) and table.num_rows:
            for _, _, words in _text_words(table):
                hit = np.flatnonzero(_inside(words, block) & found.has(window_hashes(words.hashes, block)))
                near = np.zeros(len(words) + 1, np.int64)  # windows that hold an anchor begin at most window - block words before it
                np.add.at(near, np.maximum(hit - (window - block), 0), 1)
                np.add.at(near, hit + 1, -1)
                ok = _inside(words, window)
                ok &= np.cumsum(near)[: len(ok)] > 0
                if ok.any():
                    out += _dealt(window_hashes(words.hashes, window)[ok], np.zeros(int(ok.sum()), bool), key[0].as_py(), ranges, window_hashes(words.hashes, window, True)[ok])
        return _packed(out)

    both = lambda replies: grouped.groupBy("grp").cogroup(replies.groupBy("grp"))
    twice = settled(both(anchors).applyInArrow(extend, _HASHES), _LONG, False, "windows")
    runtime.drop(anchors)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept string" * texts

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        found = _Found(replies, ranges, _LONG)
        out: tuple = ([], [], [], [], [])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for lo, hi, words in _text_words(table):
            n = len(words)
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(_inside(words, window) & found.has_both(window_hashes(words.hashes, window), lambda words=words: window_hashes(words.hashes, window, True)))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for i in range(hi - lo):
                a, b = int(words.first[i]), int(words.first[i + 1])
                cuts, kept = _kept(words, a, b, gone[a:b])
                out[0].append(b - a)
                out[1].append(int(gone[a:b].sum()))
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(cuts)
                out[4].append(kept.decode("utf-8", "replace") if texts else None)
        columns = [table["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], span), *([pa.array(out[4], pa.string())] * texts)]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", *(["kept"] * texts)])

    return both(twice).applyInArrow(remove, schema)


def _kept(words: Words, a: int, b: int, gone: np.ndarray) -> tuple[list[dict], bytes]:
    """The stretches of gone words of words a to b, and the others joined by spaces."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    cuts = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
    left = a + np.flatnonzero(~gone)
    if not len(left):
        return cuts, b""
    size = words.ends[left] - words.starts[left] + 1
    data = np.full(int(size.sum()) - 1, 32, np.uint8)
    to = ragged(np.cumsum(size) - size, size - 1)
    data[to] = words.data[ragged(words.starts[left], size - 1)]
    return cuts, data.tobytes()
