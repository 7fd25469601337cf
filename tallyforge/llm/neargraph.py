"""Approximate nearest neighbours: NN-descent builds a graph of near vectors, greedy search walks it.

Nearness is the inner product. Vectors are made equally long for the graph by one more component, sqrt(M**2 - |v|**2) with M the greatest
length, so that a neighbour's neighbour is likely a neighbour however lengths vary; queries are measured on the vectors as they are.

1. Start: for each of ORDERS orders (by the signs of BITS random projections) blocks of BLOCK consecutive vectors are compared, and each
   vector keeps its DEGREE best.
2. Descent, in rounds of Spark joins: each vector's list of new and known neighbours, and of vectors that have it as one (SAMPLE of each),
   is joined with their values; new ones are compared with all others of the list; each vector keeps the DEGREE best of what it had and
   what it was told. It ends when fewer than SETTLED of all entries are new, or after ROUNDS.
3. Search, in rounds for all queries at once: the best EXPAND of a query's beam that were not yet expanded are joined with their
   neighbours (at most DEGREE of each direction), those with their values, and the BEAM best stay. It ends when all of every beam are
   expanded. The best are measured once more in double precision and ranked.

Equal vectors are one vertex with their smallest ids, as many as can be in a result, so copies neither fill lists nor crowd a task; a copy
found stands for all. A vertex that very many have as a neighbour meets a sample of them in each round, chosen before the shuffle.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id; of
rows that share an id the one of smallest bytes counts; vectors of another number of components are not near; a query's own row is no
candidate; equal scores rank by id; fewer candidates than asked for are all returned where they are found; without vectors there is no
row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import runtime

#: Neighbours of a vector; those of a list that a round compares, of each kind; rounds at most; share of new entries at which it ends.
DEGREE, SAMPLE, ROUNDS, SETTLED = 32, 12, 6, 0.12
#: Orders, signs and block size of the start.
ORDERS, BITS, BLOCK = 3, 16, 1024
#: Candidates that a query keeps; those it expands in a round; rounds at most (a search that takes more raises).
BEAM, EXPAND, SEARCH_ROUNDS = 384, 256, 200
#: Vectors of a bucket, which a task holds; requests to a bucket that one task takes; found pairs held before they are reduced.
BUCKET, REQUESTS, HELD = 4096, 1 << 16, 1 << 20
#: Places where queries that are not of the table begin.
ENTRIES = 64

_STATE = "node long, vec binary, ids binary, scores binary, fresh binary, thr float, news long"


@dataclass
class Graph:
    """values: node, data (doubles), vec (single precision). edges: node, near (array of nodes). members: node, vec_id: the smallest ids of equal vectors. nodes: vec_id, node."""

    values: DataFrame
    edges: DataFrame
    members: DataFrame
    nodes: DataFrame
    size: int

    def drop(self) -> None:
        runtime.drop(self.values, self.edges, self.members, self.nodes)


def _whole(batches: Iterator[pa.RecordBatch], key: str = "node") -> Iterator[pa.Table]:
    """The rows of sorted batches again, cut so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bytes(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end, and how many each row has."""
    rows = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // size for r in rows], np.int64)


def _pack(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The other way: rows of sizes[i] values each."""
    offs = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray | None, most: int) -> tuple[np.ndarray, ...]:
    """Of each owner's entries the `most` best, each other once (a known one before a fresh one): owners, others, scores, fresh, sorted by owner and score."""
    order = np.lexsort((fresh if fresh is not None else np.zeros(len(owner), np.uint8), other, owner))
    owner, other, score = owner[order], other[order], score[order]
    fresh = None if fresh is None else fresh[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score = owner[keep], other[keep], score[keep]
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    first = np.searchsorted(owner, owner, "left")
    keep2 = np.arange(len(owner)) - first < most
    return owner[keep2], other[keep2], score[keep2], None if fresh is None else fresh[keep][order][keep2]


class _Told:
    """Pairs found by a task, reduced to each vertex's best before they are sent."""

    def __init__(self, most: int):
        self.most, self.parts, self.n = most, [], 0

    def add(self, owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((owner, other, score))
        self.n += len(owner)
        if self.n >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        owner, other, score, _ = _best(*(np.concatenate(c) for c in zip(*self.parts, strict=True)), None, self.most)
        self.parts, self.n = [], 0
        nodes, first, sizes = np.unique(owner, return_index=True, return_counts=True)
        ends = np.concatenate([first[1:], [len(owner)]]) if len(first) else first
        for a in range(0, len(nodes), 4096):
            b = min(a + 4096, len(nodes))
            lo, hi = first[a], ends[b - 1]
            yield _batch(node=nodes[a:b], ids=_pack(other[lo:hi], sizes[a:b]), scores=_pack(score[lo:hi].astype("<f4"), sizes[a:b]))


_TOLD = "node long, ids binary, scores binary"


def _values(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """vec_id, data: one row an id, of vectors that take part; data are doubles, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield _batch(vec_id=batch.column("vec_id"), data=_pack(flat + 0.0, np.asarray(pa.compute.list_value_length(v), np.int64)))

    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(finite, F.lit(False))).filter(F.exists("v", lambda x: x != 0))
    return rows.mapInArrow(run, "vec_id long, data binary").groupBy("vec_id").agg(F.min("data").alias("data"))


def build(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", copies: int = 21, degree: int = DEGREE, seed: int = 7) -> Graph:
    """The graph of a table of vectors; copies: ids kept of equal vectors, one more than a search is to return."""
    spark = runtime.prepare(vectors.sparkSession)
    rows = runtime.stored(_values(vectors, key, embedding).withColumn("digest", F.md5("data")), "vectors")
    equal = Window.partitionBy("digest")
    ranked = rows.select("digest", "vec_id").withColumn("k", F.row_number().over(equal.orderBy("vec_id"))).filter(F.col("k") <= copies)
    members = runtime.stored(ranked.withColumn("node", F.min("vec_id").over(equal)).select("digest", "node", "vec_id"), "members")  # of few rows each by now
    first = members.filter("node = vec_id").select("digest", "node")
    nodes = runtime.stored(rows.select("digest", "vec_id").join(first, "digest").select("vec_id", "node"), "nodes")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _bytes(batch.column("data"), "<f8")
            square = np.add.reduceat(flat * flat, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
            yield _batch(node=batch.column("vec_id"), data=batch.column("data"), vec=_pack(flat.astype("<f4"), sizes), square=square)

    distinct = rows.join(first.select(F.col("node").alias("vec_id")), "vec_id").select("vec_id", "data")
    values = runtime.stored(distinct.mapInArrow(single, "node long, data binary, vec binary, square double"), "values")
    runtime.drop(rows)
    total = values.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("m")).first()
    state = _descend(values, float(total["m"] or 0.0), degree, seed)
    edges = _both_ways(state, degree)
    runtime.drop(state)
    return Graph(values, edges, members, nodes, total["n"])


def _descend(values: DataFrame, longest: float, degree: int, seed: int) -> DataFrame:
    """The state after the last round: each node's best neighbours."""

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, sizes = _bytes(batch.column("vec"), "<f4")
            more = np.sqrt(np.maximum(longest - np.asarray(batch.column("square")), 0)).astype("<f4")
            ends = np.cumsum(sizes)
            full = np.insert(flat, ends, more)
            codes = np.zeros((ORDERS, len(sizes)), np.int64)
            for width in np.unique(sizes):
                if width not in cuts:
                    cuts[width] = np.random.default_rng([seed, int(width)]).standard_normal((int(width) + 1, ORDERS * BITS)).astype("<f4")
                at = np.flatnonzero(sizes == width)
                m = full[(ends[at] - width + at)[:, None] + np.arange(width + 1)]
                signs = (m @ cuts[width] > 0).reshape(len(at), ORDERS, BITS)
                codes[:, at] = (signs << np.arange(BITS)).sum(axis=2).T
            packed = _pack(full, sizes + 1)
            for k in range(ORDERS):
                yield _batch(node=batch.column("node"), vec=packed, turn=np.full(len(sizes), k, np.int32), width=sizes, code=codes[k])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, waiting, key = _Told(degree), [], None

        def block() -> Iterator[pa.RecordBatch]:
            if len(waiting) < 2:
                return
            nodes = np.array([n for n, _ in waiting])
            m = np.frombuffer(b"".join(v for _, v in waiting), "<f4").reshape(len(nodes), -1)
            s = m @ m.T
            np.fill_diagonal(s, -np.inf)
            k = min(degree, len(nodes) - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield from told.add(np.repeat(nodes, k), nodes[near].ravel(), np.take_along_axis(s, near, 1).ravel())

        for batch in batches:
            for node, vec, turn, width in zip(*(batch.column(c).to_pylist() for c in ("node", "vec", "turn", "width")), strict=True):
                if (turn, width) != key or len(waiting) >= BLOCK:
                    yield from block()
                    waiting, key = [], (turn, width)
                waiting.append((node, vec))
        yield from block()
        yield from told.out()

    spark = values.sparkSession
    dealt = values.select("node", "vec", "square").mapInArrow(longer, "node long, vec binary, turn int, width long, code long")
    long = runtime.stored(dealt, "orders")
    keys = ("turn", "width", "code", "node")
    start = long.repartitionByRange(*keys).sortWithinPartitions(*keys).select("node", "vec", "turn", "width").mapInArrow(compared, _TOLD)
    none = F.lit(b"")
    blank = long.filter("turn = 0").select("node", "vec", none.alias("ids"), none.alias("scores"), none.alias("fresh"), F.lit(float("-inf")).cast("float").alias("thr"), F.lit(0).cast("long").alias("news"))
    state = runtime.stored(_merged(blank, start, degree), "state")
    runtime.drop(long)
    for k in range(ROUNDS):
        news, n = state.agg(F.coalesce(F.sum("news"), F.lit(0)), F.count(F.lit(1))).first()
        if news <= SETTLED * n * degree:
            break
        new = runtime.stored(_merged(state, _compared(state, degree, seed + k), degree), "state")
        runtime.drop(state)
        state = new
    return state


def _taken(fresh: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries a round takes: of each owner's, in order of score, SAMPLE fresh and SAMPLE known ones."""
    out = np.zeros(len(fresh), bool)
    for kind in (0, 1):
        at = np.flatnonzero(fresh == kind)
        first = np.searchsorted(owner[at], owner[at], "left")
        out[at[np.arange(len(at)) - first < SAMPLE]] = True
    return out


def _listed(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, neighbour, score and fresh of every entry."""
    ids, sizes = _bytes(batch.column("ids"), "<i8")
    return np.repeat(np.arange(len(sizes)), sizes), ids, _bytes(batch.column("scores"), "<f4")[0], _bytes(batch.column("fresh"), "u1")[0]


def _compared(state: DataFrame, degree: int, salt: int) -> DataFrame:
    """What a round tells each node: pairs of the lists of a common neighbour."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, _, fresh = _listed(batch)
            some = _taken(fresh, row)
            yield _batch(owner=np.asarray(batch.column("node"))[row[some]], member=ids[some], fresh=fresh[some].astype(np.int32))

    forth = state.select("node", "ids", "scores", "fresh").mapInArrow(lists, "owner long, member long, fresh int")
    back = forth.select(F.col("member").alias("owner"), F.col("owner").alias("member"), "fresh").withColumn("h", F.xxhash64("owner", "member", F.lit(salt)))
    back = back.withColumn("k", F.row_number().over(Window.partitionBy("owner", "fresh").orderBy("h", "member"))).filter(F.col("k") <= SAMPLE)
    every = forth.unionByName(back.select("owner", "member", "fresh"))
    sent = every.join(state.select(F.col("node").alias("member"), "vec", "thr"), "member").select("owner", "member", "fresh", "vec", "thr")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told(degree)
        for table in _whole(batches, "owner"):
            owner, member, fresh, thr = (np.asarray(table.column(c)) for c in ("owner", "member", "fresh", "thr"))
            order = np.lexsort((-fresh, member, owner))
            keep = np.ones(len(order), bool)
            o, m = owner[order], member[order]
            keep[1:] = (o[1:] != o[:-1]) | (m[1:] != m[:-1])
            order = order[keep]
            order = order[np.lexsort((-fresh[order], owner[order]))]  # new ones first
            vec = table.column("vec").to_pylist()
            owner, member, fresh, thr = owner[order], member[order], fresh[order], thr[order]
            bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
            found: list[tuple] = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                new = int(fresh[lo:hi].sum())
                if not new or hi - lo < 2:
                    continue
                v = np.frombuffer(b"".join([vec[i] for i in order[lo:hi]]), "<f4").reshape(hi - lo, -1)
                s = v[:new] @ v.T
                t, ids = thr[lo:hi], member[lo:hi]
                s[np.arange(new), np.arange(new)] = -np.inf
                i, j = np.nonzero(s > t[:new, None])
                found.append((ids[i], ids[j], s[i, j]))
                s[:, :new] = -np.inf  # pairs of new ones are told from either side already
                i, j = np.nonzero(s > t[None, :])
                found.append((ids[j], ids[i], s[i, j]))
            if found:
                yield from told.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
        yield from told.out()

    return sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(local, _TOLD)


def _merged(state: DataFrame, told: DataFrame, degree: int) -> DataFrame:
    """The next state: of each node's entries and what it was told the best, entries of a round's lists known from now on."""
    none = F.lit(None)
    news = told.select("node", none.cast("binary").alias("vec"), "ids", "scores", none.cast("binary").alias("fresh"), none.cast("float").alias("thr"), none.cast("long").alias("news"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            node = np.asarray(table.column("node"))
            old = np.asarray(table.column("vec").is_valid())
            ids, sizes = _bytes(table.column("ids"), "<i8")
            row, score = np.repeat(np.arange(len(sizes)), sizes), _bytes(table.column("scores"), "<f4")[0]
            fresh = np.ones(len(ids), np.uint8)
            was = old[row]
            if was.any():
                known = _bytes(table.column("fresh").filter(pa.array(old)), "u1")[0].copy()
                known[_taken(known, row[was])] = 0
                fresh[was] = known
            owner, other, score, fresh = _best(node[row], ids, score, fresh, degree)
            kept = np.flatnonzero(old)
            lo, hi = np.searchsorted(owner, node[kept], "left"), np.searchsorted(owner, node[kept], "right")
            n = hi - lo
            thr = np.full(len(kept), -np.inf, np.float32)
            thr[n == degree] = score[hi[n == degree] - 1]
            added = np.concatenate([[0], np.cumsum(fresh, dtype=np.int64)])
            yield _batch(node=node[kept], vec=table.column("vec").filter(pa.array(old)).combine_chunks(), ids=_pack(other, n), scores=_pack(score.astype("<f4"), n), fresh=_pack(fresh, n), thr=thr, news=added[hi] - added[lo])

    return state.unionByName(news).repartition("node").sortWithinPartitions("node").mapInArrow(run, _STATE)


def _both_ways(state: DataFrame, degree: int) -> DataFrame:
    """node, near: its neighbours and, of the nodes that have it as a neighbour, the `degree` nearest."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, score, _ = _listed(batch)
            yield _batch(a=np.asarray(batch.column("node"))[row], b=ids, score=score)

    forth = state.select("node", "ids", "scores", "fresh").mapInArrow(lists, "a long, b long, score float")
    back = forth.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")
    back = back.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("k") <= degree)
    every = forth.select("a", "b").unionByName(back.select("a", "b"))
    return runtime.stored(every.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("near")), "edges")  # at most 2 * degree of each


def search(graph: Graph, starts: DataFrame, limit: int = 20, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """query, node, score: for each of starts (query long, data: doubles as bytes, at: array of nodes to begin at) the best nodes found, `limit` of them and, where it is a query's place to begin, that."""
    spark = graph.values.sparkSession
    room = max(beam, 2 * limit)
    buckets = max(1, -(-graph.size // BUCKET))
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "bucket"):
            which = np.asarray(table.column("bucket"))
            node = np.asarray(table.column("node"))
            vec = table.column("vec").to_pylist()
            bounds = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                order = lo + np.argsort(node[lo:hi])
                rows = [vec[i] for i in order]
                yield _batch(bucket=[int(which[lo])], ids=[node[order].tobytes()], sizes=[np.array([len(r) // 4 for r in rows], "<i8").tobytes()], vecs=[b"".join(rows)])

    flat = graph.values.select(bucket, "node", "vec").repartition("bucket").sortWithinPartitions("bucket")
    blocks = runtime.stored(flat.mapInArrow(packed, "bucket long, ids binary, sizes binary, vecs binary"), "blocks")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _bytes(batch.column("data"), "<f8")
            n = len(sizes)
            at = batch.column("at")
            ids = [np.asarray(x, "<i8") for x in at.to_pylist()]
            counts = np.array([len(x) for x in ids], np.int64)
            ids = np.concatenate(ids) if n else np.zeros(0, "<i8")
            # Places to begin are unmeasured (infinite), so that they are expanded; what they are worth is found last.
            yield _batch(node=batch.column("query"), vec=_pack(flat.astype("<f4"), sizes), ids=_pack(ids, counts), scores=_pack(np.full(len(ids), np.inf, "<f4"), counts), fresh=_pack(np.ones(len(ids), "u1"), counts), thr=np.full(n, -np.inf, np.float32), news=counts)

    beams = runtime.stored(starts.select("query", "data", "at").mapInArrow(begun, _STATE), "beams")
    asked = beams.count()
    parts = spark.conf.get("spark.sql.shuffle.partitions")

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, _, fresh = _listed(batch)
            at = np.flatnonzero(fresh)
            at = at[np.arange(len(at)) - np.searchsorted(row[at], row[at], "left") < expand]
            yield _batch(query=np.asarray(batch.column("node"))[row[at]], node=ids[at])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests to buckets: of each query the neighbours that its beam doesn't hold."""
        for table in _whole(batches, "query"):
            query = np.asarray(table.column("query"))
            own = np.asarray(table.column("vec").is_valid())
            vec, thr = table.column("vec").to_pylist(), np.asarray(table.column("thr"))
            ids, sizes = _bytes(table.column("ids"), "<i8")
            near = table.column("near").combine_chunks()
            counts = pa.compute.fill_null(pa.compute.list_value_length(near), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            got, hold = near.flatten().to_numpy(zero_copy_only=False), np.repeat(query, sizes)
            q, c = np.concatenate([hold, np.repeat(query, counts)]), np.concatenate([ids, got]).astype(np.int64)
            held = np.concatenate([np.zeros(len(hold), np.uint8), np.ones(len(got), np.uint8)])
            order = np.lexsort((held, c, q))
            q, c, held = q[order], c[order], held[order]
            keep = held == 1
            keep[1:] &= (q[1:] != q[:-1]) | (c[1:] != c[:-1])
            q, c = q[keep], c[keep]
            place = {int(query[i]): i for i in np.flatnonzero(own)}
            b = _bucket(c, buckets)
            order = np.lexsort((b, q))
            q, c, b = q[order], c[order], b[order]
            cut = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (b[1:] != b[:-1])])) if len(q) else np.zeros(0, np.int64)
            ends = np.concatenate([cut[1:], [len(q)]]) if len(cut) else cut
            for lo in range(0, len(cut), 2048):
                hi = min(lo + 2048, len(cut))
                at = [place[int(x)] for x in q[cut[lo:hi]]]
                yield _batch(bucket=b[cut[lo:hi]], query=q[cut[lo:hi]], vec=pa.array([vec[i] for i in at], pa.binary()), thr=thr[at].astype(np.float32), ids=_pack(c[cut[lo] : ends[hi - 1]], ends[lo:hi] - cut[lo:hi]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("query", "vec", "thr", "ids", "sizes"))
            for query, vec, thr, ids, sizes in zip(*columns, strict=True):
                if query is None:
                    size = np.frombuffer(sizes, "<i8")
                    block = np.frombuffer(ids, "<i8"), np.cumsum(size) - size, np.frombuffer(vec, "<f4"), size
                    continue
                want, v = np.frombuffer(ids, "<i8"), np.frombuffer(vec, "<f4")
                at = np.searchsorted(block[0], want)
                like = block[3][at] == len(v)
                want, at = want[like], at[like]
                s = block[2][block[1][at][:, None] + np.arange(len(v))] @ v
                best = np.flatnonzero(s > thr)
                if len(best) > room:
                    best = best[np.argpartition(-s[best], room - 1)[:room]]
                if len(best):
                    out.append((query, want[best].astype("<i8").tobytes(), s[best].astype("<f4").tobytes()))
            if out:
                yield _batch(node=[o[0] for o in out], ids=pa.array([o[1] for o in out], pa.binary()), scores=pa.array([o[2] for o in out], pa.binary()))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            node = np.asarray(table.column("node"))
            old = np.asarray(table.column("vec").is_valid())
            ids, sizes = _bytes(table.column("ids"), "<i8")
            row, score = np.repeat(np.arange(len(sizes)), sizes), _bytes(table.column("scores"), "<f4")[0]
            fresh = np.ones(len(ids), np.uint8)
            was = old[row]
            flags = _bytes(table.column("fresh").filter(pa.array(old)), "u1")[0].copy()
            at = np.flatnonzero(flags)
            r = row[was][at]
            flags[at[np.arange(len(at)) - np.searchsorted(r, r, "left") < expand]] = 0
            fresh[was] = flags
            owner, other, score, fresh = _best(node[row], ids, score, fresh, room)
            rows = np.flatnonzero(old)
            lo, hi = np.searchsorted(owner, node[rows], "left"), np.searchsorted(owner, node[rows], "right")
            n = hi - lo
            thr = np.full(len(rows), -np.inf, np.float32)
            thr[n == room] = score[hi[n == room] - 1]
            left = np.concatenate([[0], np.cumsum(fresh, dtype=np.int64)])
            yield _batch(node=node[rows], vec=table.column("vec").filter(pa.array(old)).combine_chunks(), ids=_pack(other, n), scores=_pack(score.astype("<f4"), n), fresh=_pack(fresh, n), thr=thr, news=left[hi] - left[lo])

    none = F.lit(None)
    for _ in range(SEARCH_ROUNDS):
        open_ = beams.filter("news > 0")
        if not open_.limit(1).count():
            break
        steps = open_.select("node", "ids", "scores", "fresh").mapInArrow(frontier, "query long, node long").join(graph.edges, "node")
        rows = open_.select(F.col("node").alias("query"), "vec", "thr", "ids", none.cast("array<long>").alias("near"))
        rows = rows.unionByName(steps.select("query", none.cast("binary").alias("vec"), none.cast("float").alias("thr"), F.lit(b"").alias("ids"), "near"))
        requests = rows.repartition("query").sortWithinPartitions("query").mapInArrow(wanted, "bucket long, query long, vec binary, thr float, ids binary")
        held, salt, copies = None, F.lit(0), blocks.withColumn("salt", F.lit(0))
        if asked > REQUESTS:  # else no bucket can get more: a query asks a bucket once in a round
            held = requests = runtime.stored(requests, "requests")
            loads = requests.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("salts"))
            requests = requests.join(loads, "bucket")
            salt = F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")
            copies = blocks.join(loads, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        a = requests.select("bucket", salt.alias("salt"), "query", "vec", "thr", "ids", none.cast("binary").alias("sizes"))
        b = copies.select("bucket", "salt", none.cast("long").alias("query"), F.col("vecs").alias("vec"), none.cast("float").alias("thr"), "ids", "sizes")
        found = a.unionByName(b).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.asc_nulls_first("query")).select("query", "vec", "thr", "ids", "sizes").mapInArrow(measured, _TOLD)
        told = found.select("node", none.cast("binary").alias("vec"), "ids", "scores", none.cast("binary").alias("fresh"), none.cast("float").alias("thr"), none.cast("long").alias("news"))
        new = open_.unionByName(told).repartition("node").sortWithinPartitions("node").mapInArrow(kept, _STATE)
        new = runtime.stored(new.unionByName(beams.filter("news = 0")), "beams")
        runtime.drop(*([held] if held is not None else []), beams)
        beams = new
    else:
        raise RuntimeError(f"a search did not end in {SEARCH_ROUNDS} rounds")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best 2 * limit by single precision, and places to begin, for a last measure."""
        for batch in batches:
            row, ids, score, _ = _listed(batch)
            start = np.isinf(score)
            rest = np.flatnonzero(~start)
            rest = rest[np.arange(len(rest)) - np.searchsorted(row[rest], row[rest], "left") < 2 * limit]
            at = np.sort(np.concatenate([np.flatnonzero(start), rest]))
            yield _batch(query=np.asarray(batch.column("node"))[row[at]], node=ids[at])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("data", "other"))
            s = [float(np.dot(np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8"))) if len(x) == len(y) else None for x, y in zip(a, b, strict=True)]
            yield _batch(query=batch.column("query"), node=batch.column("node"), score=pa.array(s, pa.float64()))

    last = beams.select("node", "ids", "scores", "fresh").mapInArrow(ends, "query long, node long")
    last = last.join(graph.values.select("node", F.col("data").alias("other")), "node").join(starts.select("query", "data"), "query")
    out = runtime.stored(last.mapInArrow(exact, "query long, node long, score double").filter("score IS NOT NULL"), "found")
    runtime.drop(blocks, beams)
    return out


def _bucket(nodes: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(node), buckets) as Spark computes it (seed 42), for many nodes."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = u(42) + p5 + u(8)
        k = nodes.astype(np.int64).view(u) * p2
        k = ((k << u(31)) | (k >> u(33))) * p1
        h = h ^ k
        h = ((h << u(27)) | (h >> u(37))) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        h = h ^ (h >> u(32))
    return np.mod(h.view(np.int64), buckets)


def nearest(vectors: DataFrame, chosen=None, limit: int = 20, key: str = "vec_id", embedding: str = "embedding", queries: DataFrame | None = None, **how) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the `limit` vectors of largest inner product that the search finds, nearest first.

    Queries are the rows of vectors where the condition `chosen` on their id column (named vec_id) holds, each without its own row; or,
    with `queries` (query_id long, embedding), other vectors, which begin at ENTRIES nodes of as many components.
    """
    graph = build(vectors, key, embedding, copies=limit + 1, **{k: v for k, v in how.items() if k in ("degree", "seed")})
    beam = {k: v for k, v in how.items() if k in ("beam", "expand")}
    if queries is None:
        ids = graph.nodes if chosen is None else graph.nodes.filter(chosen)
        asked = ids.select(F.col("node").alias("query")).distinct()
        starts = asked.join(graph.values.select(F.col("node").alias("query"), "data"), "query").withColumn("at", F.array("query"))
        names = ids.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    else:
        width = F.octet_length("data").alias("width")
        place = F.row_number().over(Window.partitionBy("width").orderBy(F.xxhash64("node"), "node"))
        some = graph.values.select("node", width).withColumn("k", place).filter(F.col("k") <= ENTRIES).groupBy("width").agg(F.collect_list("node").alias("at"))  # ENTRIES of each
        starts = _values(queries, "query_id", "embedding").select(F.col("vec_id").alias("query"), "data", width).join(some, "width").select("query", "data", "at")
        names = starts.select(F.col("query").alias("query_id"), "query")
    starts = runtime.stored(starts, "starts")
    found = search(graph, starts, limit, **beam)
    some = found.join(graph.members.select("node", "vec_id"), "node")
    # A query's own id may be one of these, so one more.
    short = some.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= limit + 1)
    rows = names.join(short.select("query", "vec_id", "score"), "query")
    if queries is None:
        rows = rows.filter("vec_id != query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= limit).select("query_id", "rank", "vec_id", "score")
