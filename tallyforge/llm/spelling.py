"""Spelling variants: words that differ by one letter, by a trie self-join with active-node sets.

1. Words: runs of letters are counted, first in each task.
2. Trie: the vocabulary's trie is cut into parts of at most PART words: a prefix with more is split by its next letter, as deep as that
   takes. Every word ends with a terminator, so a word that is another's prefix has a place of its own.
3. Join: an active pair is two nodes whose prefixes differ by at most one letter. From a node that is paired with itself come its children
   with themselves (no letter spent), each two children (a letter replaced) and the node with each child (a letter inserted); a pair
   that has spent its letter goes on to children of equal letters. Above the parts, Spark joins take pairs down a level at a time; once
   both nodes are within parts, a task gets the two parts and goes on to the terminals, all active nodes of a level at once.
4. A word's form is its most frequent near word, if that is FACTOR times as frequent; roots come by pointer jumping.

A prefix has at most some hundred near prefixes, however many words there are (letters times places), so a part is sent that often at
most, and no task holds more than two parts.

Defined results: a null or empty text has no words; rows count one by one, repeated or not; a document without an id is named by the
empty text; ties in frequency go to the smallest word; a table without words gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import runtime
from tallyforge.llm.text import ragged, slices

#: Letters of a word, occurrences of it, and how many times as frequent its form is, at least. Of how many runs one loses a letter.
LETTERS, OCCURRENCES, FACTOR, SPOILT = 6, 5, 5, 199
#: Words of a part of the trie; distinct words that a task counts before it sends them; depth at which pairs are completed by lookup.
PART, HELD, DEEP = 1 << 13, 1 << 19, 40

#: Ends every word in the trie; no letter.
END = "\x01"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, carried on from the crc32 of what is before it."""
    crc = before ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    live, k = np.flatnonzero((size > 0) & (size <= 64)), 0
    while len(live):
        crc[live] = _CRC[(crc[live] ^ data[starts[live] + k]) & 255] ^ (crc[live] >> 8)
        k += 1
        live = live[size[live] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return crc


def _found(ids: list, data: np.ndarray, offs: np.ndarray, spoilt: int, letters: int) -> pa.Array:
    """The words of some texts, with repeats."""
    lead = data == 0xC3  # of two bytes, for the letters from U+00C0 to U+00FF and no others
    mark = _LETTER[data] | lead
    mark[1:] |= lead[:-1]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(mark[1:], mark[:-1], out=edge[1:-1])
    edge[offs] = True
    cuts = np.flatnonzero(edge)
    run = mark[cuts[:-1]]
    starts, ends = cuts[:-1][run], cuts[1:][run]
    first = np.searchsorted(starts, offs)
    low = _LOW[data]
    points = np.concatenate([[0], np.cumsum(mark & ((data & 0xC0) != 0x80))])  # letters before each byte
    length = points[ends] - points[starts]
    some = length >= letters
    starts, ends, length = starts[some], ends[some], length[some]
    named = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    doc = np.repeat(np.arange(len(ids)), np.diff(first))[some]
    h = _checksums(low, starts, ends, named[doc])
    bad = np.flatnonzero(h % spoilt == 0)
    if len(bad):
        at = np.searchsorted(points, points[starts[bad]] + (h[bad] % length[bad].astype(np.uint32)).astype(np.int64), "right") - 1
        mark = mark.copy()
        mark[at] = False
        two = at[data[at] == 0xC3]
        mark[two + 1] = False
        length[bad] -= 1
    kept = np.concatenate([[0], np.cumsum(mark)])
    size = kept[ends] - kept[starts]
    some = length >= letters
    starts, size = starts[some], size[some]
    text = low[mark]
    text = text[ragged(kept[starts], size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))


def words(docs: DataFrame, spoilt: int = SPOILT, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: words of enough letters and occurrences. spoilt: one of so many runs loses a letter."""
    runtime.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0

        def counted() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": t["word"], "n": t["n_sum"]})

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offs in slices(batch.column("text")):
                if not len(data):
                    continue
                v = pc.value_counts(_found(ids[lo:hi], data, offs, spoilt, letters))
                held.append(pa.table({"word": v.field("values"), "n": v.field("counts")}))
                n += len(v)
                if n > 4 * HELD:
                    held = [counted()]
                    n = held[0].num_rows
                    if n > HELD:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                        held, n = [], 0
        if held:
            yield from counted().combine_chunks().to_batches(max_chunksize=1 << 16)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class _Trie:
    """Words of a part below a prefix, level by level: nodes are numbers in order; keys of a level are node * 256 + letter of its words."""

    def __init__(self, words: list[bytes], prefix: bytes):
        lo = bisect_left(words, prefix)
        hi = bisect_left(words, True, lo, key=lambda w: not w.startswith(prefix))
        self.words, self.skip = words[lo:hi], len(prefix)
        rest = [w[self.skip :] for w in self.words]
        self.buffer = np.frombuffer(b"".join(rest) + b"\0", np.uint8)
        self.size = np.array([len(r) for r in rest], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        alive = np.flatnonzero(self.size)
        #: Of each level: for every node the letter, the parent and its first word; the words and nodes that go on; how many words a node has.
        self.keys, self.firsts, self.counts = [], [], []
        node, k = np.zeros(len(alive), np.int64), 0
        while len(alive):
            key = node * 256 + self.buffer[self.offset[alive] + k]
            new = np.ones(len(key), bool)  # words are sorted, and so are their keys
            np.not_equal(key[1:], key[:-1], out=new[1:])
            first = np.flatnonzero(new)
            node, count = np.cumsum(new) - 1, np.diff(np.append(first, len(key)))
            self.keys.append(key[first])
            self.firsts.append(alive[first])
            self.counts.append(count)
            k += 1
            go = self.size[alive] > k
            if k >= DEEP:
                go &= count[node] > 1
            alive, node = alive[go], node[go]
        self._places: dict[bytes, int] | None = None

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of nodes at a level (0: above the first letters) the first child and the one after the last."""
        if level >= len(self.keys):
            return np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        return np.searchsorted(self.keys[level], nodes * 256), np.searchsorted(self.keys[level], nodes * 256 + 256)

    def place(self, word: bytes) -> int:
        if self._places is None:
            self._places = {w: i for i, w in enumerate(self.words)}
        return self._places.get(word, -1)


def _down(a: _Trie, b: _Trie, begin: dict[tuple[int, int], list], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Take active pairs that have spent their letter down to terminals. begin: by level of a's and b's nodes, pairs of nodes that become active there."""
    if not begin:
        return
    shift = next(iter(begin))
    gap, level, last = shift[1] - shift[0], min(k[0] for k in begin), max(k[0] for k in begin)
    u = v = np.zeros(0, np.int64)
    while len(u) or level <= last:
        for x, y in begin.get((level, level + gap), []):
            u, v = np.concatenate([u, x]), np.concatenate([v, y])
        if level + gap >= DEEP and len(u):
            _looked_up(a, b, level, level + gap, u, v, out)
            u = v = np.zeros(0, np.int64)
        elif len(u):
            lo, hi = a.children(level, u)
            child, other = ragged(lo, hi - lo), np.repeat(v, hi - lo)
            if level + gap >= len(b.keys) or not len(child):
                u = v = np.zeros(0, np.int64)
            else:
                letter = a.keys[level][child] & 255
                want, have = other * 256 + letter, b.keys[level + gap]
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                hit = have[at] == want
                u, v, letter = child[hit], at[hit], letter[hit]
                ended = letter == ord(END)
                out.append((a.firsts[level][u[ended]], b.firsts[level + gap][v[ended]]))
                u, v = u[~ended], v[~ended]
        level += 1


def _looked_up(a: _Trie, b: _Trie, i: int, j: int, u: np.ndarray, v: np.ndarray, out: list) -> None:
    """Pairs of very long words: for each word of one node the word of the other that it would be."""
    found = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        first = a.firsts[i - 1][x] if i else 0
        head = b.words[b.firsts[j - 1][y] if j else 0][: b.skip + j]
        for w in range(first, first + (int(a.counts[i - 1][x]) if i else len(a.words))):
            at = b.place(head + a.words[w][a.skip + i :])
            if at >= 0:
                found.append((w, at))
    if found:
        out.append((np.array([f[0] for f in found]), np.array([f[1] for f in found])))


def near_pairs(first: list[bytes], second: list[bytes], one: bytes, other: bytes, same: bool) -> tuple[list[bytes], list[bytes]]:
    """Pairs of words at distance one below two active nodes: prefixes `one` and `other` of words in two sorted parts, each word with its terminator.

    same: the prefixes are the same node, no letter is spent; otherwise they differ by one letter already.
    """
    a = _Trie(first, one)
    b = a if same else _Trie(second, other)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if not same:
        if one.endswith(END.encode()):  # both prefixes are whole words
            return (a.words, b.words) if a.words and b.words else ([], [])
        if len(a.words) and len(b.words):
            _down(a, b, {(0, 0): [(np.zeros(1, np.int64), np.zeros(1, np.int64))]}, out)
    else:
        replaced: dict[tuple[int, int], list] = {}
        inserted: dict[tuple[int, int], list] = {}
        nodes = np.zeros(1 if len(a.words) > 1 else 0, np.int64)
        level = 0
        while len(nodes) and level < len(a.keys):
            lo, hi = a.children(level, nodes)
            kids, parent = ragged(lo, hi - lo), np.repeat(nodes, hi - lo)
            real = (a.keys[level][kids] & 255) != ord(END)
            kids, parent = kids[real], parent[real]
            inserted.setdefault((level, level + 1), []).append((parent, kids))
            # Each two children: every child with those after it of the same parent.
            after = np.searchsorted(parent, parent, "right") - np.arange(len(parent)) - 1
            replaced.setdefault((level + 1, level + 1), []).append((np.repeat(kids, after), kids[ragged(np.arange(len(kids)) + 1, after)]))
            nodes = kids[a.counts[level][kids] > 1]
            level += 1
        _down(a, a, replaced, out)
        _down(a, a, inserted, out)
    x = np.concatenate([o[0] for o in out]).tolist() if out else []
    y = np.concatenate([o[1] for o in out]).tolist() if out else []
    return [a.words[i] for i in x], [b.words[i] for i in y]


def pairs(vocabulary: DataFrame, part: int = PART) -> DataFrame:
    """a, b: each two words of the vocabulary (word, n) at distance one, once in either order."""
    spark = vocabulary.sparkSession
    full = vocabulary.select(F.concat("word", F.lit(END)).alias("w"))
    # The trie down to its parts: nodes (node, parent, letter, heavy), and for every word its part.
    total = full.count()
    nodes, inside, depth, open_ = [], [], 0, full
    while total > part:
        depth += 1
        prefix = F.substring("w", 1, depth)
        level = runtime.stored(open_.groupBy(prefix.alias("node")).agg((F.count(F.lit(1)) > part).alias("heavy")), "trie")
        nodes.append(level.select("node", F.substring("node", 1, depth - 1).alias("parent"), F.substring("node", depth, 1).alias("letter"), "heavy"))
        dealt = open_.join(level.withColumnRenamed("node", "part"), prefix == F.col("part"))
        inside.append(dealt.filter("NOT heavy").select("w", "part"))
        if not level.filter("heavy").limit(1).count():
            break
        open_ = runtime.stored(dealt.filter("heavy").select("w"), "open")
    if not nodes:
        inside.append(full.withColumn("part", F.lit("")))
    dealt = inside[0]
    for more in inside[1:]:
        dealt = dealt.unionByName(more)
    # At most `part` words each, as one text with a line for each: much faster to pass on than a list.
    packs = runtime.stored(dealt.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("w")), "\n").alias("words")), "parts")
    work = _active(nodes, spark) if nodes else packs.select(F.lit("").alias("one"), F.lit("").alias("other"), F.lit("").alias("one_part"), F.lit("").alias("other_part"), F.lit(True).alias("same"))
    work = work.join(packs.select(F.col("part").alias("one_part"), F.col("words").alias("first")), "one_part")
    work = work.join(packs.select(F.col("part").alias("other_part"), F.col("words").alias("second")), "other_part").select("one", "other", "same", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("one", "other", "same", "first", "second")}
                first, second = (row[c].encode("latin-1").split(b"\n") for c in ("first", "second"))
                x, y = near_pairs(first, second, row["one"].encode("latin-1"), row["other"].encode("latin-1"), row["same"])
                if x:
                    yield pa.RecordBatch.from_arrays([pa.array([w[:-1].decode("latin-1") for w in c]) for c in (x, y)], names=["a", "b"])

    found = work.mapInArrow(run, "a string, b string")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _active(levels: list[DataFrame], spark) -> DataFrame:
    """one, other, one_part, other_part, same: active pairs of nodes that both lie in parts, taken down the trie above the parts."""
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    kids = runtime.stored(every, "nodes")
    part = F.when(~F.col("heavy"), F.col("node"))
    one = kids.select(F.col("parent").alias("one"), F.col("letter").alias("l1"), F.col("node").alias("n1"), part.alias("p1"))
    other = kids.select(F.col("parent").alias("other"), F.col("letter").alias("l2"), F.col("node").alias("n2"), part.alias("p2"))
    columns = ("one", "other", "one_part", "other_part", "same")
    active = spark.createDataFrame([("", "", None, None, True)], "one string, other string, one_part string, other_part string, same boolean")
    ready = []
    while True:
        itself = active.filter("same").select("one", "other")
        paired = itself.join(one, "one").join(other, "other").filter((F.col("l1") != END) & (F.col("l2") != END))
        children = paired.filter(F.col("l1") <= F.col("l2")).select(F.col("n1").alias("one"), F.col("n2").alias("other"), F.col("p1").alias("one_part"), F.col("p2").alias("other_part"), (F.col("l1") == F.col("l2")).alias("same"))
        longer = itself.join(other, "other").filter(F.col("l2") != END).select("one", F.col("n2").alias("other"), F.lit(None).cast("string").alias("one_part"), F.col("p2").alias("other_part"), F.lit(False).alias("same"))
        spent = active.filter("NOT same")
        both = spent.filter("one_part IS NULL AND other_part IS NULL").select("one", "other").join(one, "one").join(other, "other").filter(F.col("l1") == F.col("l2"))
        both = both.select(F.col("n1").alias("one"), F.col("n2").alias("other"), F.col("p1").alias("one_part"), F.col("p2").alias("other_part"), F.lit(False).alias("same"))
        # Where one node lies in a part already, its child is a prefix in the same part, whether or not it has words.
        left = spent.filter("one_part IS NULL AND other_part IS NOT NULL").join(one, "one").select(F.col("n1").alias("one"), F.concat("other", "l1").alias("other"), F.col("p1").alias("one_part"), "other_part", "same")
        right = spent.filter("one_part IS NOT NULL AND other_part IS NULL").join(other, "other").select(F.concat("one", "l2").alias("one"), F.col("n2").alias("other"), "one_part", F.col("p2").alias("other_part"), "same")
        nxt = children.unionByName(longer).unionByName(both).unionByName(left).unionByName(right).select(*columns)
        nxt = runtime.stored(nxt.distinct(), "active")
        ready.append(nxt.filter("one_part IS NOT NULL AND other_part IS NOT NULL"))
        active = nxt.filter("one_part IS NULL OR other_part IS NULL")
        if not active.limit(1).count():
            break
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.distinct()


def variants(docs: DataFrame, spoilt: int = SPOILT, letters: int = LETTERS, occurrences: int = OCCURRENCES, factor: int = FACTOR, part: int = PART) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    vocabulary = runtime.stored(words(docs, spoilt, letters, occurrences), "words")
    half = runtime.stored(pairs(vocabulary, part), "near")
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    near = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best"))
    known = vocabulary.join(near, "word", "left")
    most = -F.col("best.m")
    formed = most >= factor * F.col("n")
    known = runtime.stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.b")).alias("form"), F.when(formed, most).alias("form_n")), "forms")
    steps = runtime.stored(known.filter("form IS NOT NULL").select("word", F.col("form").alias("at")), "roots")
    while True:  # forms grow in frequency by the factor, so there are few rounds
        jump = steps.select(F.col("word").alias("at"), F.col("at").alias("to"))
        new = runtime.stored(steps.join(jump, "at", "left").select("word", F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        runtime.drop(steps)
        steps = new.select("word", "at")
        steps.tallyforge_path = new.tallyforge_path
        if not moved:
            break
    out = known.join(steps.select("word", F.col("at").alias("root")), "word", "left")
    runtime.drop(half, vocabulary)
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
