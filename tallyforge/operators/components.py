"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import drop, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, root for every id in edges (a, b): root is the smallest id that can be reached.

    Every vertex takes the smallest label among its own and its neighbours', then that label's own label (pointer jumping), until nothing
    changes; labels are kept in the shared folder between rounds. Neighbours' labels are reduced before each shuffle, so a vertex with
    very many edges is one row for each task.
    """
    both = edges.filter("a != b").select("a", "b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("root").alias("jump"))
        new = stored(low.join(up, "low", "left").select("id", F.least("low", "jump").alias("root"), (F.least("low", "jump") != F.col("old")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        drop(labels)
        labels = new.drop("moved")
        labels.tallyforge_path = new.tallyforge_path
        if not moved:
            drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
