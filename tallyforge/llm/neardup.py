"""MinHash near-duplicates by an LSH forest, with every link confirmed on full shingle sets.

1. Each text's set of word shingles is hashed; equal sets are collapsed to one representative.
2. Forest: TREES orders of the signature. In each, representatives are sorted by their DEPTH values (a range partition, so no key is
   ever gathered in one task). Neighbours with a common prefix form regions, and a region goes as deep as it must to hold at most REGION
   texts: one value where few share it, SURE values at most elsewhere. A prefix of SURE values that more texts share is crowded: it is
   searched in deeper regions first, then as in step 4. In a region, texts whose signatures agree on nearly as many places as the
   threshold asks are candidates.
3. Candidates' connected components are clusters; no link leaves its cluster. A cluster of at most REGION texts is compared on full
   sets in one group; a larger one region by region, in all trees. Shared shingles of all pairs in a group are counted at once
   (a matrix product for frequent shingles, direct counts for rare ones); no pair is ever a row. A region of more than SHINGLES
   shingles is compared in pairs of its blocks.
4. The texts of a crowded prefix are dealt into blocks, and every two blocks are compared on signatures, then on full sets, except two
   blocks of one component of the links found so far. Copies of one text are one component by then, so they cost nothing; many texts
   that are alike but not linked cost the square of their number, in tasks of two blocks.
5. The confirmed links' components are the answer.

Every group has about REGION texts and SHINGLES shingles (or few long texts), so no task grows with the input; there is no cap on how
many texts may be linked. A link at the threshold itself shares one value in a tree with that probability, so it misses all TREES trees,
in a sparse region, with probability (1 - 0.8) ** 12 = 4e-9; anywhere, at most (1 - 0.8 ** SURE) ** 12 = 2e-4, however many texts are alike.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle is one
shingle; repeated rows are equal sets; rows that share a doc_id share its component; a row without doc_id is linked with nothing, its
component is null and it is kept; an empty table gives no rows; other columns are not read by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import runtime
from tallyforge.operators.components import components
from tallyforge.llm.text import NOT_SPACE, Words, mix, slices, window_hashes

HASHES, TREES, DEPTH, SURE = 128, 12, 8, 3
REGION, SHINGLES = 1024, 2_000_000
#: Standard deviations below the threshold at which signatures still make candidates: one miss in 100,000.
SLACK = 4.3

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offs, NOT_SPACE, lower=True)
    every, out = window_hashes(words.hashes, width), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(window_hashes(words.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of 32 bits for each non-empty set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    step = 1 << 18
    a = 0
    sizes = np.array([len(s) for s in sets])
    while a < len(sets):  # sets together, up to `step` shingles, for each hash function in turn
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), step, "right")))
        x = np.concatenate(sets[a:b])
        at = np.cumsum(sizes[a:b]) - sizes[a:b]
        for k in range(HASHES):
            out[a:b, k] = np.minimum.reduceat((x * _MULTIPLIERS[k]) >> np.uint64(32), at)
        a = b
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                sets = shingle_sets(data, offs, width)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                prints, mins = np.zeros((2, hi - lo), np.int64), [None] * (hi - lo)
                if len(some):
                    got = minhashes([sets[i] for i in some])
                    for i, m in zip(some.tolist(), got, strict=True):
                        mins[i] = m.tobytes()
                        s = sets[i]
                        with np.errstate(over="ignore"):
                            prints[:, i] = np.array([s.sum(), mix(s + np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(s))]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), pa.array(mins, pa.binary())], names=["doc_id", "n", "f1", "f2", "mins"])

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each representative and tree: the tree's key (its number, then DEPTH values), and one byte of each hash."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        mins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, HASHES)
        brief = pa.array([x.tobytes() for x in mins.astype(np.uint8)], pa.binary())
        for t in range(TREES):
            key = np.empty((n, 1 + 4 * DEPTH), np.uint8)
            key[:, 0] = t
            cols = (np.arange(DEPTH) + t * HASHES // TREES) % HASHES
            key[:, 1:] = np.ascontiguousarray(mins[:, cols].astype(">u4")).view(np.uint8).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary()), batch.column(0), batch.column(1), brief], names=["key", "id", "n", "brief"])


def _agreements(sig: np.ndarray) -> np.ndarray:
    if len(sig) <= 16:
        return (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(sig.shape[1]):
        out += sig[:, k, None] == sig[None, :, k]
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric adjacency matrix: the first vertex of its component."""
    n = len(adjacent)
    low = np.arange(n)
    adjacent = adjacent | np.eye(n, dtype=bool)
    while True:
        new = np.where(adjacent, low[None, :], n).min(axis=1)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _split(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Regions of rows sorted by key (a matrix of values): as deep as needed for `most` texts."""
    todo = [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if depth and hi - lo <= most:
            yield lo, hi
        elif depth < keys.shape[1]:
            cuts = [lo, *(lo + 1 + np.flatnonzero(keys[lo + 1 : hi, depth] != keys[lo : hi - 1, depth])).tolist(), hi]
            todo += [(a, b, depth + 1) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
        else:  # runs that overlap by half; pairs in no run are found in blocks
            yield from ((a, min(hi, a + most)) for a in range(lo, max(lo + 1, hi - most // 2), most // 2))


def _candidates(region: int, ids: np.ndarray, n: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Region, id, root, n of each text that is near another."""
    root = roots(near)
    some = np.flatnonzero(np.bincount(root, minlength=len(ids))[root] > 1)
    if not len(some):
        return None
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return np.full(len(some), region), ids[some], low[root[some]], n[some]


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["region", "id", "root", "n"])


def _regions(least: int, most: int):
    """From rows sorted by key: region, id, root, n of each text with a candidate beside it; root is the smallest id it is joined to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest = TaskContext.get().partitionId() << 33, None
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
                if rest.num_rows < 4 * most:
                    continue
            elif rest is None:
                return
            rest = rest.combine_chunks()
            raw = np.frombuffer(b"".join(rest["key"].to_pylist()), np.uint8).reshape(rest.num_rows, -1)
            top = np.zeros((len(raw), 8), np.uint8)
            top[:, 3:] = raw[:, :5]
            top = top.view(">u8").ravel()
            cut = rest.num_rows if batch is None else int(np.searchsorted(top, top[-1]))  # the last value's rows may go on
            if not cut and rest.num_rows < 64 * most:
                continue
            if not cut:  # a sure prefix is not cut unless it is crowded
                sure = raw[:, : 1 + 4 * SURE]
                cut = int(np.argmax((sure == sure[-1]).all(axis=1))) or rest.num_rows
            keys = np.concatenate([top[:cut, None].astype(np.int64), raw[:cut, 5:].copy().view(">u4").astype(np.int64)], axis=1)
            ids, n = rest["id"].to_numpy()[:cut], rest["n"].to_numpy()[:cut]
            brief = None
            out = []
            for lo, hi in _split(keys, most):
                if brief is None:
                    brief = np.frombuffer(b"".join(rest["brief"].slice(0, cut).to_pylist()), np.uint8).reshape(cut, HASHES)
                near = _agreements(brief[lo:hi]) >= least
                if near.sum() == hi - lo:
                    continue
                if (got := _candidates(number, ids[lo:hi], n[lo:hi], near)) is not None:
                    out.append(got)
                number += hi - lo
            if out:
                yield _batch(out)
            rest = rest.slice(cut) if cut < rest.num_rows else None

    return run


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which they are sorted."""
    rest = None
    for batch in _then_none(batches):
        if batch is not None and batch.num_rows:
            rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if rest is None:
            continue
        key = rest.column(0).to_numpy()
        cuts = [0, *(1 + np.flatnonzero(key[1:] != key[:-1])).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:] if batch is None else cuts[1:-1], strict=False):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-2])


def _across(least: int):
    """From rows of grp, id, n, comp, brief sorted by grp: as _regions, of the texts with a candidate of another component beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            comp = rows["comp"].to_numpy()
            brief = np.frombuffer(b"".join(rows["brief"].to_pylist()), np.uint8).reshape(-1, HASHES)
            near = (comp[:, None] != comp[None, :]) & (_agreements(brief) >= least)
            if (got := _candidates(rows["grp"][0].as_py(), rows["id"].to_numpy(), rows["n"].to_numpy(), near)) is not None:
                yield _batch([got])

    return run


def _crowded(trees: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """Candidates as of _regions from the rows of crowded prefixes (sure, id, n, brief), in pairs of blocks; comps (id, root) are the components of known links."""
    half = REGION // 2
    rows = trees.join(comps, "id", "left").select("sure", "id", "n", "brief", F.coalesce("root", "id").alias("comp"))
    per = rows.groupBy("sure", "comp").agg(F.count(F.lit(1)).alias("k"))
    own = per.filter(F.col("k") > half).select("sure", "comp", F.ceil(F.col("k") / half).alias("parts"))
    mixed = per.filter(F.col("k") <= half).groupBy("sure").agg(F.ceil(F.sum("k") / half).alias("mixed"))
    # Blocks of a large component have its id in own; the others' texts are mixed.
    dealt = rows.join(own, ["sure", "comp"], "left").join(mixed, "sure", "left").withColumn("own", F.when(F.col("parts").isNotNull(), F.col("comp")))
    dealt = dealt.withColumn("block", F.xxhash64("sure", F.col("own").isNull(), "own", F.pmod(F.xxhash64("id"), F.coalesce("parts", "mixed"))))
    dealt = runtime.stored(dealt.select("sure", "own", "block", "id", "n", "comp", "brief"), "dealt")
    blocks = dealt.select("sure", "own", "block").distinct()
    other = blocks.select("sure", F.col("own").alias("own2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "sure").filter((F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)))
    pairs = pairs.select("block", "block2", (F.xxhash64("sure", "block", "block2").bitwiseAND((1 << 62) - 1) + (1 << 62)).alias("grp"))
    sides = pairs.select("block", "grp").unionByName(pairs.filter("block != block2").select(F.col("block2").alias("block"), "grp"))
    groups = dealt.join(sides, "block").select("grp", "id", "n", "comp", "brief")
    return groups.repartition("grp").sortWithinPartitions("grp").mapInArrow(_across(least), "region long, id long, root long, n long")


def _bounded(parts: DataFrame) -> DataFrame:
    """grp, id from grp, id, n: a group of over 2 * REGION texts or SHINGLES shingles becomes one for every two of its blocks."""
    size = parts.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    blocks = F.greatest(F.lit(3), F.least(F.col("k"), F.ceil(F.greatest(2 * F.col("k") / REGION, 2 * F.col("s") / SHINGLES))))
    size = size.filter((F.col("k") > 2 * REGION) | (F.col("s") > SHINGLES)).select("grp", blocks.cast("int").alias("blocks"))
    rows = parts.join(size, "grp", "left").withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # With three blocks or more, every two texts, also of one block, meet in some pair of different blocks.
    y = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("y", y).filter(F.col("blocks").isNull() | (F.col("x") != F.col("y")))
    pair = F.xxhash64("grp", F.least("x", "y"), F.greatest("x", "y"))
    return rows.select(F.when(F.col("blocks").isNull(), F.col("grp")).otherwise(pair).alias("grp"), "id")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(x, kind="stable")
    x, doc = x[by], doc[by]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(first, len(x)))
    out = np.zeros(n * n)
    often = np.flatnonzero(size > 64)
    for a in range(0, len(often), 2048):
        part = often[a : a + 2048]
        m = np.zeros((n, len(part)), np.float32)
        rows = np.concatenate([doc[first[i] : first[i] + size[i]] for i in part.tolist()])
        m[rows, np.repeat(np.arange(len(part)), size[part])] = 1
        out += (m @ m.T).ravel()
    for d in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        at = first[size == d]
        for a in range(0, len(at), max(1, (1 << 20) // (d * d))):
            ids = doc[at[a : a + max(1, (1 << 20) // (d * d)), None] + np.arange(d)]
            out += np.bincount((ids[:, :, None] * n + ids[:, None, :]).ravel(), minlength=n * n)
    out = out.reshape(n, n).astype(np.int64)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _confirm(width: int, percent: int):
    """From rows of grp, id, text sorted by grp: a (id), b (the smallest id it is linked to, directly or not) within each group."""

    def judge(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        common = shared(sets)
        root = roots(100 * common >= percent * (size[:, None] + size[None, :] - common))
        low: dict[int, int] = {}
        for i, r in zip(ids, root.tolist(), strict=True):
            low[r] = min(i, low.get(r, i))
        return [(i, low[r]) for i, r in zip(ids, root.tolist(), strict=True) if i != low[r]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, out = None, [], [], []
        for batch in batches:
            groups, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offs in slices(batch.column(2)):
                for k, s in enumerate(shingle_sets(data, offs, width), lo):
                    if groups[k] != group:
                        if len(ids) > 1:
                            out += judge(ids, sets)
                        group, ids, sets = groups[k], [], []
                    ids.append(names[k])
                    sets.append(s)
            if len(out) > 5000:
                yield _pairs(out)
                out = []
        if len(ids) > 1:
            out += judge(ids, sets)
        if out:
            yield _pairs(out)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (whether that is itself) for each row of doc_id, text.

    A link: shingles of `width` words in common are at least `percent` of those in either. Texts are compared with A-Z lower-cased;
    words are runs without ASCII white space.
    """
    runtime.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = runtime.stored(rows.mapInArrow(_signatures(width), "doc_id long, n long, f1 long, f2 long, mins binary"), "signatures")
    classes = marks.filter("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    classes = runtime.stored(classes, "classes")

    stored_trees = trees = runtime.stored(classes.select("rep", "n", "mins").mapInArrow(_trees, "key binary, id long, n long, brief binary"), "trees")
    trees = trees.withColumn("sure", F.substring("key", 1, 1 + 4 * SURE))
    crowded = runtime.stored(trees.groupBy("sure").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > REGION), "crowded")
    # Only a crowded prefix may lie in several partitions.
    apart = trees.join(crowded, "sure", "left")
    sort = apart.repartitionByRange("sure", F.when(F.col("k").isNotNull(), F.col("key")), F.when(F.col("k").isNotNull(), F.col("id"))).sortWithinPartitions("key", "id")
    sort = sort.select("key", "id", "n", "brief")
    j = percent / 100
    least = int(HASHES * (j - SLACK * (j * (1 - j) / HASHES) ** 0.5))
    beside = runtime.stored(sort.mapInArrow(_regions(least, REGION), "region long, id long, root long, n long"), "regions")

    clusters = components(beside.select(F.col("id").alias("a"), F.col("root").alias("b")))
    member = beside.select("id", "n").distinct().join(clusters, "id")
    large = member.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).filter((F.col("k") > REGION) | (F.col("s") > SHINGLES)).select("root")
    small = member.join(large, "root", "left_anti").select((-F.col("root") - 1).alias("grp"), "id")
    parts = beside.select("region", "id", "n").join(member.join(large, "root", "left_semi").select("id").distinct(), "id").select(F.col("region").alias("grp"), "id", "n")

    def confirmed(groups: DataFrame) -> DataFrame:
        groups = runtime.stored(groups, "groups")
        # A doc_id may stand in several rows; each has its own text, and all of them are compared.
        texts = rows.join(groups.withColumnRenamed("id", "doc_id"), "doc_id").select("grp", F.col("doc_id").alias("id"), "text")
        links = runtime.stored(texts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_confirm(width, percent), "a long, b long"), "links")
        runtime.drop(groups)
        return links

    links = confirmed(small.unionByName(_bounded(parts)))
    runtime.drop(beside)
    joined = components(links)
    if crowded.limit(1).count():
        beside = runtime.stored(_crowded(trees.join(crowded, "sure", "left_semi"), joined, least), "regions")
        more = confirmed(_bounded(beside.select(F.col("region").alias("grp"), "id", "n")))
        runtime.drop(beside)
        joined = components(links.unionByName(more))
        runtime.drop(more)
    runtime.drop(stored_trees, crowded, links)
    class_of = classes.select("f1", "f2", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("root"))
    out = marks.select("doc_id", "n", "f1", "f2").join(class_of, ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each component the row with the smallest doc_id stays. Rows with a null doc_id stay.

    Of rows that share a doc_id the one with the smallest text stays; those few are set apart, so the others' texts aren't shuffled for it.
    """
    gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = runtime.stored(gone, "gone")
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = runtime.stored(docs.select(F.col("doc_id").alias("_again")).filter("_again IS NOT NULL").groupBy("_again").count().filter("count > 1").select("_again"), "again")
    if not again.limit(1).count():
        return left
    once = left.join(again, left["doc_id"] == again["_again"], "left_anti")
    more = left.join(again, left["doc_id"] == again["_again"], "left_semi").select(F.struct("*").alias("doc"))
    first = F.row_number().over(Window.partitionBy("doc.doc_id").orderBy("doc.text"))
    return once.unionByName(more.withColumn("k", first).filter("k = 1").select("doc.*"))
