"""Connected components of a graph that no machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscape.session import Workspace


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``label`` (the smallest node reachable), one row per node of an edge.

    ``edges`` has two whole-number columns. Rounds of large and small stars: every node hands its
    neighbours on to the smallest node it knows. Edges shrink to one per node, minima combine
    before each shuffle, and joins on a hub are ones that adaptive execution can split. Each round is
    written and read back, so lineage stays short. Rows with a null end are left out.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    oriented = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = ws.store(oriented, f"{name}-0")
    state, k = _state(now), 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: the neighbours above a node go to the smallest it knows.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: those below it, and the node itself.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        after = ws.store(below.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now, last, state = after, state, _state(after)
        if state == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
