"""Connected components of a match graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.session import discard, materialise

#: Rounds after which the loop gives up with an error; a round at least halves long chains.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node that has an edge; the component is its smallest node.

    Each edge points from the larger node (``child``) to the smaller (``parent``). A round has
    two steps, after Kiveris et al., "Connected Components in MapReduce and Beyond" (2014):
    every parent is replaced by its own smallest parent, then every child keeps its smallest
    parent and its other parents are hooked to that one. Both steps look up one row per node
    by key; the edges of a hub are split by adaptive execution, which such joins allow. The edges are
    written after each round, which cuts the lineage, and the round before is removed; the loop
    ends when a round changes nothing.
    """
    a, b = F.col(src), F.col(dst)
    start = (edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
             .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct())
    metrics = {"checksum": F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))}
    forest, seen = materialise(start, "components", **metrics)
    for _ in range(MAX_ROUNDS):
        after, now = materialise(_round(forest), "components", **metrics)
        if now == seen:
            nodes = forest.select(F.col("child").alias("node"), F.col("parent").alias("component"))
            roots = forest.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
            discard(after)
            return nodes.unionByName(roots)
        discard(forest)
        forest, seen = after, now
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def _round(edges: DataFrame) -> DataFrame:
    up = _smallest_parent(edges, "parent", "up")
    lifted = edges.join(up, "parent", "left").select("child", F.coalesce("up", "parent").alias("parent"))
    hooked = lifted.join(_smallest_parent(lifted, "child", "best"), "child")
    pairs = F.array(F.struct(F.col("child"), F.col("best").alias("parent")),
                    F.struct(F.col("parent").alias("child"), F.col("best").alias("parent")))
    return hooked.select(F.inline(pairs)).filter("child <> parent").distinct()


def _smallest_parent(edges: DataFrame, key: str, name: str) -> DataFrame:
    return edges.groupBy(F.col("child").alias(key)).agg(F.min("parent").alias(name))


def assign_clusters(records: DataFrame, record_id: str, edges: DataFrame) -> DataFrame:
    """Every record exactly once: ``record_id, cluster_id``; a record without edges is its own cluster."""
    parts = connected_components(edges).withColumnRenamed("node", record_id)
    return (records.select(record_id).join(parts, record_id, "left")
            .select(record_id, F.coalesce(F.col("component"), F.col(record_id)).cast("string").alias("cluster_id")))
