"""Outlier models as tables: nearest neighbours on a grid of cells, local outlier factor, density clusters, isolation trees.

Points are rows (id, and columns of numbers, the features). Distances are Euclidean; scale features first (scaled()). Points without an
id, or with a null, NaN or infinite feature, take no part. Points of equal features are one place with a weight, so very many equal
points cost what one does; all are in the results.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.storage import drop, stored

#: Deepest level of the grid: 2**LEVELS cells along each feature.
LEVELS = 24


def scaled(rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """id and features less their mean, over their standard deviation (0 for a constant one), over all rows."""
    s = rows.agg(*(g(c).alias(f"{n}_{c}") for c in features for n, g in (("m", F.avg), ("s", F.stddev_pop))))
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in features]
    return rows.crossJoin(F.broadcast(s)).select(F.col(key).alias("id"), *z)  # one row of statistics


def _places(points: DataFrame, features: list[str]) -> DataFrame:
    """id, place (the smallest id of equal points), x (array of the features)."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    ok = points.select("id", x.alias("x")).filter(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    first = ok.groupBy("x").agg(F.min("id").alias("place"), F.count(F.lit(1)).alias("weight"))
    return ok.join(first, "x").select("id", "place", "x", "weight")


def _distance(a: str, b: str, size: int) -> Column:
    """Square root of the sum of squares, in the order of the features."""
    return F.sqrt(reduce(lambda s, k: s + (F.col(a)[k] - F.col(b)[k]) * (F.col(a)[k] - F.col(b)[k]), range(1, size), (F.col(a)[0] - F.col(b)[0]) * (F.col(a)[0] - F.col(b)[0])))


def _around(size: int, after: bool = False) -> Column:
    """For explode(): the steps to all cells that a point within a cell's diagonal may lie in; after: only those that come later in order."""
    reach = math.isqrt(size) + 1
    steps = itertools.product(range(-reach, reach + 1), repeat=size)
    return F.array(*(F.array(*(F.lit(v) for v in s)) for s in steps if not after or s > (0,) * size))


def k_nearest(points: DataFrame, features: list[str], k: int = 20) -> DataFrame:
    """place, other, d, w, k_distance: for each place (distinct point) its nearest others, all within its k-distance.

    The k-distance is that within which k other points lie, copies of the place and ties included: w is how many points the other place
    is (its own: copies besides itself, d = 0). With fewer points than that, all are neighbours.

    The grid has levels, each cell halved along every feature. A place is looked for at the deepest level where its cell holds more than
    k points: they are within the cell's diagonal, so all that are as near lie in the ring of that many cells around, and one join on
    cells is enough, however dense some regions are. A level that no place is looked for at is not joined.
    """
    d = len(features)
    rows = _places(points, features)
    p = stored(rows.filter("id = place").select("place", "x", "weight").distinct(), "places")
    low_high = p.agg(*(F.min(F.col("x")[i]).alias(f"low{i}") for i in range(d)), *(F.max(F.col("x")[i]).alias(f"high{i}") for i in range(d))).first()
    if low_high[0] is None:
        return p.select("place", F.col("place").alias("other"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("w"), F.lit(0.0).alias("k_distance"))
    low = [low_high[f"low{i}"] for i in range(d)]
    side = max(max(low_high[f"high{i}"] - low[i] for i in range(d)), 1e-300) * (1 + 1e-9)
    deep = F.array(*(F.floor((F.col("x")[i] - low[i]) / side * (1 << LEVELS)).cast("long") for i in range(d)))
    cell = F.transform("deep", lambda c: F.call_function("shiftright", c, F.lit(LEVELS) - F.col("level")))
    at = stored(p.withColumn("deep", deep).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).select("place", "x", "weight", "level", cell.alias("cell")), "cells")
    full = stored(at.groupBy("level", "cell").agg(F.sum("weight").alias("n")).filter((F.col("n") > k) | (F.col("level") == 0)), "full")
    deepest = at.join(full, ["level", "cell"]).groupBy("place").agg(F.max("level").alias("level"))
    asked = at.join(deepest, ["place", "level"]).select("place", "level", "cell", "x", "weight")
    asked = asked.withColumn("s", F.explode(_around(d))).withColumn("cell", F.zip_with("cell", "s", lambda a, b: a + b)).drop("s")
    near = asked.join(at.select("level", "cell", F.col("place").alias("other"), F.col("x").alias("y"), F.col("weight").alias("w")), ["level", "cell"])
    near = near.select("place", "other", _distance("x", "y", d).alias("d"), F.when(F.col("place") == F.col("other"), F.col("w") - 1).otherwise(F.col("w")).alias("w")).filter("w > 0")
    # The k-distance: where the running number of points reaches k. Most candidates go by rank before the running sum: each is a point at least.
    rank = Window.partitionBy("place").orderBy("d", "other")
    first = near.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k)
    upto = F.sum("w").over(rank.rowsBetween(Window.unboundedPreceding, -1))
    bound = first.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < k).groupBy("place").agg(F.max("d").alias("k_distance"))
    out = stored(near.join(bound, "place").filter("d <= k_distance").select("place", "other", "d", "w", "k_distance"), "near")
    drop(at, full)
    return out


def local_outlier_factor(points: DataFrame, features: list[str], k: int = 20) -> DataFrame:
    """id, k_distance, density, factor of every point: how much denser its k nearest neighbours lie than it does; about 1 inside a region of even density.

    A point's reachability distance from a neighbour is their distance, or the neighbour's k-distance if that is more; its density is
    1 / (their mean + 1e-10); the factor is the neighbours' mean density over its own, 1 for a point without neighbours.
    """
    rows = _places(points, features)
    near = k_nearest(points, features, k)
    ends = near.select(F.col("place").alias("other"), F.col("k_distance").alias("reach")).distinct()
    reached = near.join(ends, "other").withColumn("far", F.greatest("d", "reach"))
    density = reached.groupBy("place", "k_distance").agg((1 / (F.sum(F.col("far") * F.col("w")) / F.sum("w") + 1e-10)).alias("density"))
    density = stored(density, "density")
    around = near.select("place", "other", "w").join(density.select(F.col("place").alias("other"), F.col("density").alias("theirs")), "other")
    factor = around.groupBy("place").agg((F.sum(F.col("theirs") * F.col("w")) / F.sum("w")).alias("theirs")).join(density, "place").select("place", "k_distance", "density", (F.col("theirs") / F.col("density")).alias("factor"))
    return rows.select("id", "place").join(factor, "place", "left").select("id", "k_distance", "density", F.coalesce("factor", F.lit(1.0)).alias("factor"))


def density_clusters(points: DataFrame, features: list[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """id, cluster, core of every point: core points have `least` points within eps, themselves included; a cluster is what core points reach in steps of eps, named by its smallest core id; other points within eps of a core point belong to the smallest such cluster; the rest are noise (null).

    Cells are as wide as eps over the root of the number of features, so all points of a cell are within eps of each other: a cell with
    `least` points is all core and one cluster without a comparison. Others are compared with those of the cells around; two cells of core
    points are linked by their closest points, and components are found over cells' links.
    """
    from tallyforge.operators.components import components

    d = len(features)
    rows = stored(_places(points, features), "points")
    width = eps / math.sqrt(d) * (1 - 1e-12)
    p = stored(rows.filter("id = place").select("place", "x", "weight").distinct().withColumn("cell", F.transform("x", lambda v: F.floor(v / width).cast("long"))), "places")
    crowded = p.groupBy("cell").agg(F.sum("weight").alias("n")).filter(F.col("n") >= least).select("cell")
    sparse = p.join(crowded, "cell", "left_anti")

    def beside(a: DataFrame, b: DataFrame, after: bool = False) -> DataFrame:
        """Places of a with those of b within eps; after: in later cells only."""
        a = a.select(F.col("place").alias("a"), F.col("x").alias("xa"), F.col("cell").alias("cell_a")).withColumn("s", F.explode(_around(d, after))).withColumn("cell", F.zip_with("cell_a", "s", lambda u, v: u + v))
        b = b.select(F.col("place").alias("b"), F.col("x").alias("xb"), F.col("weight").alias("w"), "cell")
        return a.join(b, "cell").filter(_distance("xa", "xb", d) <= eps).select("a", "b", "w", "cell_a", F.col("cell").alias("cell_b"))

    counted = beside(sparse, p).groupBy("a").agg(F.sum("w").alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("place"))
    core = stored(p.join(crowded, "cell", "left_semi").select("place", "x", "weight", "cell").unionByName(sparse.join(counted, "place", "left_semi").select("place", "x", "weight", "cell")), "core")
    # Core points of a cell are one cluster: the cell's smallest core place stands for it.
    cells = core.groupBy("cell").agg(F.min("place").alias("first"))
    links = beside(core, core, after=True).select("cell_a", "cell_b").distinct()
    links = links.join(cells.select(F.col("cell").alias("cell_a"), F.col("first").alias("a")), "cell_a").join(cells.select(F.col("cell").alias("cell_b"), F.col("first").alias("b")), "cell_b").select("a", "b")
    roots = components(links)
    named = cells.join(roots.withColumnRenamed("id", "first"), "first", "left").select("cell", F.coalesce("root", "first").alias("root"))
    core_of = stored(core.join(named, "cell").select("place", F.col("root").alias("cluster")), "clusters")
    border = beside(sparse.join(core_of, "place", "left_anti"), core).join(core_of.select(F.col("place").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("place")).agg(F.min("cluster").alias("cluster"))
    every = core_of.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return rows.select("id", "place").join(every, "place", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 up to 1 that the parts decide: the first 8 hexadecimal digits of the md5 of their texts, joined by colons."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def isolation_trees(points: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """tree, node, size, feature, cut: random trees over samples, as rows: node 1 is the root, 2n and 2n + 1 are the children of n; points with feature < cut go to 2n. Leaves have no feature.

    A tree's sample are the `sample` points of smallest hash of tree and id; grown level by level for all trees at once, to a depth of
    log2(sample). A node's feature is chosen among those that vary in it, and its cut between their least and greatest values, by hashes
    of seed, tree and node. There are at most trees * 4 * sample rows.
    """
    x = F.array(*(F.col(c).cast("double") for c in features))
    ok = points.select("id", x.alias("x")).filter(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    n = ok.count()
    # Of each tree about twice as many as needed, and of those the smallest hashes.
    share = min(1.0, (2 * sample + 64) / max(n, 1))
    some = ok.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", uniform(seed, F.col("tree"), F.col("id"))).filter(F.col("h") < share)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "id"))
    live = stored(some.withColumn("k", place).filter(F.col("k") <= sample).select("tree", "x", F.lit(1).cast("long").alias("node")), "sample")
    d, levels = len(features), []
    for depth in range(math.ceil(math.log2(max(sample, 2))) + 1):
        ranges = [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("low", F.min), ("high", F.max))]
        g = live.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), *ranges)
        varies = F.filter(F.array(*(F.when(F.col(f"high{i}") > F.col(f"low{i}"), F.lit(i)) for i in range(d))), lambda v: v.isNotNull())
        g = g.withColumn("varies", varies)
        last = depth == math.ceil(math.log2(max(sample, 2)))
        pick = F.floor(uniform(seed, "feature", F.col("tree"), F.col("node")) * F.size("varies")).cast("int")
        g = g.withColumn("feature", F.when((F.size("varies") > 0) & (F.col("size") > 1) & F.lit(not last), F.get("varies", pick)))
        low, high = (F.get(F.array(*(F.col(f"{name}{i}") for i in range(d))), F.col("feature")) for name in ("low", "high"))
        # Above the least value, so that neither side is empty.
        g = g.select("tree", "node", "size", "feature", F.when(F.col("feature").isNotNull(), high - uniform(seed, "cut", F.col("tree"), F.col("node")) * (high - low)).alias("cut"))
        nodes = stored(g, "nodes")
        levels.append(nodes)
        if last or not nodes.filter("feature IS NOT NULL").limit(1).count():
            break
        split = nodes.filter("feature IS NOT NULL").select("tree", "node", "feature", "cut")
        j = live.join(split, ["tree", "node"])
        new = stored(j.select("tree", "x", (F.col("node") * 2 + (F.get("x", F.col("feature")) >= F.col("cut")).cast("long")).alias("node")), "sample")
        drop(live)
        live = new
    drop(live)
    return reduce(DataFrame.unionByName, levels)


def average_path(n: Column) -> Column:
    """Mean depth of a point in a random tree of n points: 2 H(n - 1) - 2 (n - 1) / n, with H(i) = ln(i) + 0.5772156649; 1 for two points, 0 for one."""
    return F.when(n > 2, 2 * (F.log(n - 1.0) + 0.5772156649) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)


def isolation_scores(points: DataFrame, features: list[str], nodes: DataFrame, sample: int = 256) -> DataFrame:
    """id, score of every point: 2 ** -(mean path length over the trees / average_path(sample)); near 1 for what few cuts isolate.

    nodes are isolation_trees(), a bounded number of rows, which are sent to all tasks; points go down all trees a level a join.
    """
    x = F.array(*(F.col(c).cast("double") for c in features))
    ok = points.select("id", x.alias("x")).filter(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    top = nodes.filter("node = 1").select("tree", F.col("size").alias("whole"))
    trees = (nodes.agg(F.max("tree")).first()[0] or 0) + 1
    at = ok.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("path"), F.lit(False).alias("done"))
    for _ in range(math.ceil(math.log2(max(sample, 2))) + 1):
        j = at.join(F.broadcast(nodes), ["tree", "node"], "left")
        leaf = F.col("feature").isNull()
        at = j.select(
            "id", "x", "tree", F.when(F.col("done") | leaf, F.col("node")).otherwise(F.col("node") * 2 + (F.get("x", F.col("feature")) >= F.col("cut")).cast("long")).alias("node"),
            F.when(F.col("done"), F.col("path")).when(leaf, F.col("path") + average_path(F.col("size"))).otherwise(F.col("path") + 1).alias("path"), (F.col("done") | leaf).alias("done"),
        )
    whole = top.agg(F.max("whole").alias("whole"))
    mean = at.groupBy("id").agg(F.avg("path").alias("path"))
    return mean.crossJoin(F.broadcast(whole)).select("id", "path", F.pow(F.lit(2.0), -F.try_divide(F.col("path"), average_path(F.col("whole")))).alias("score"))  # one row
