"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import stage


def _stars(edges: DataFrame, large: bool, often: int | None) -> DataFrame:
    """One step on edges (u > v): each node's neighbours (those above it, or those below and itself) point to its least.

    Nodes of more than `often` neighbours are broadcast to their edges; there are 2 n / `often` of them at most. None:
    there are too few edges for such a node.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # partial minima before the shuffle; a node with very many neighbours is one row here
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if often is None:
        rest = both.join(least.drop("n"), "u")
        return _moved(rest, least.select("u", "m"), large)
    hubs = F.broadcast(least.where(F.col("n") > often).select("u", F.col("m").alias("hub")))
    marked = both.join(hubs, "u", "left")
    rest = marked.where("hub is null").select("u", "v").hint("merge").join(least.where(F.col("n") <= often).select("u", "m").hint("merge"), "u")
    joined = marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest.select("u", "v", "m"))
    return _moved(joined, least.select("u", "m"), large)


def _moved(joined: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """The new edges, from edges with the least node m around each u."""
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is its least node. Lone nodes do not appear.

    Each round is written to the shared folder, so neither lineage nor a lost executor's work piles up. The number of
    rounds grows with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct()
    now = stage(pairs, label)
    n, seen = now.count(), None
    for _ in range(most_rounds):
        often = max(1000, n // 500) if n > 1000 else None
        now = stage(_stars(_stars(now, True, often), False, often), label)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark.n, mark.s) == seen:
            break
        n, seen = mark.n, (mark.n, mark.s)
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
