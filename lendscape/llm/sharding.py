"""Sharding by a hash tree: region, rack and shard are drawn level by level by weight.

At each level a document draws one number per child from its key and the child's name; the child
with the smallest ``-ln(u) / weight`` wins, so children win in proportion to their weights. Draws of
one child do not depend on the others: when a weight grows, documents move into that subtree only,
and nothing moves inside or between the subtrees that keep their weights.

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

SEED = "tree-1"
ROWS_PER_CELL = 2048


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight; an inner node weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> Node:
    """Shards of equal weight, ``per_rack`` to a rack and ``racks`` to a region."""
    racked = [
        Node(f"rack{k // per_rack}", tuple(Node(f"shard{s}", shard=s) for s in range(k, min(k + per_rack, shards))))
        for k in range(0, shards, per_rack)
    ]
    return Node("root", tuple(Node(f"region{k // racks}", tuple(racked[k : k + racks])) for k in range(0, len(racked), racks)))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and a region of its own.

    Only the new region adds weight at the top, so the rows that move all move into the new shard.
    """
    leaf = Node(f"shard{shard}", shard=shard, own_weight=weight)
    region = Node(f"region+{shard}", (Node(f"rack+{shard}", (leaf,)),))
    return Node(root.name, (*root.children, region))


def _cost(key: Column, child: Node) -> Column:
    drawn = (common.draw(F.lit(SEED), key, F.lit(child.name)) + 1) / F.lit(float(2**52 + 1))
    return -F.log(drawn) / F.lit(float(child.weight))


def with_shard(docs: DataFrame, root: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard each key descends to, a level at a time. A null key counts as an empty one.

    No shuffle: a row's shard depends on its key and the tree alone. Children without weight are never
    drawn, and an only child needs no draw.
    """
    level, at, columns = [root], F.lit(0), docs.columns
    while any(n.children for n in level):
        below, chosen = [], []
        for k, node in enumerate(level):
            live = [c for c in node.children if c.weight > 0] or [node]
            numbers = range(len(below), len(below) + len(live))
            best = F.lit(numbers[0])
            if len(live) > 1:
                drawn = [F.struct(_cost(F.col(key), c).alias("cost"), F.lit(n).alias("n")) for c, n in zip(live, numbers, strict=True)]
                best = F.array_min(F.array(*drawn))["n"]
            chosen.append((at == k, best))
            below += live
        step = F.lit(None).cast("int")
        for here, best in reversed(chosen):
            step = F.when(here, best).otherwise(step)
        docs, level, at = docs.withColumn("_at", step), below, F.col("_at")
    return docs.withColumn(name, F.get(F.array(*[F.lit(n.shard) for n in level]), at)).select(*columns, name)


def with_slots(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, in the order of a draw from the first order column.

    Shards are cut into cells of about ROWS_PER_CELL rows, so no task ever sorts a shard.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_CELL))))
    cut = F.shiftright(F.col("_draw"), 52 - bits) if bits else F.lit(0).cast("long")
    drawn = df.withColumn("_draw", common.draw(F.lit("slot"), F.col(order[0]))).withColumn("_cell", cut)
    placed = common.running_total(drawn, ["shard"], "_cell", ["_draw", *order], F.lit(1).cast("long"), "slot")
    return placed.drop("_draw", "_cell")


def write_shards(docs: DataFrame, path: str, root: Node, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Documents as Parquet, one directory per shard; big shards are split over tasks and files."""
    dealt = with_shard(docs, root, key).hint("rebalance", "shard")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 8, ws: Workspace | None = None) -> DataFrame:
    """Per document its shard, its slot there, and its shard if there were one more.

    Law ``key``: doc_id and the number of shards decide. A null text has no bytes and is of size 1;
    rows with a null doc_id share the empty key; repeated rows get slots of their own. Other columns
    are ignored.
    """
    root = tree(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = with_shard(with_shard(rows, root), grown(root, shards), name="grown_shard")
    held = (ws or Workspace(spark, "shards")).store(rows, "rows")
    out = with_slots(held, held.count(), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
