"""The prefix trie of conversations, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. It is named by a hash of the sequence, and then by its owner, the smallest
conversation that begins with it, and its depth: an owner's nodes are a stretch of its own turns, so a node's ancestor
at any depth is looked up by (conversation, depth) and needs no walk. Hashes of prefixes are running sums of hashed
(depth, turn), so a conversation of any length is cut into stretches and never gathered.

Sums over subtrees: the parent-edge forest is split at centroids. Every node weighs as many as the different conversations
that pass it, so the weight below a node is known from the start; a component's centroid is its deepest node with
more than half of the component's weight below it. Taking it out leaves its children's subtrees and the part above,
each of at most half the weight. What the centroid's subtree holds in the component, one total, is added to
the nodes on the path from the centroid to the component's top, whose weights lose the centroid's. A chain of n
nodes so takes log n rounds instead of n. Components of up to LOCAL nodes are split on by the same rule inside a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

TURNS_PER_CELL = 1024
IDS_PER_CHUNK = 4096
LOCAL = 1 << 13
SUMS = ("s0", "s1", "s2", "s3")


def said(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, ``said`` (128 bits of SHA-256 of role and text, null as empty) and the text's words.

    Rows without a conv_id belong to no conversation and go.
    """
    role, text = (F.sha2(F.coalesce(c, F.lit("")), 256) for c in ("role", "text"))
    turn = F.substring(F.sha2(F.concat(role, text), 256), 1, 32)
    named = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), turn.alias("said"), common.n_words("text").alias("words")
    )
    return named


def placed(turns: DataFrame) -> DataFrame:
    """Adds ``pos``, the place in the conversation from 0: by turn, null first, then by ``said``."""
    block = F.coalesce(F.floor(F.col("turn") / TURNS_PER_CELL), F.lit(-(1 << 62)))
    held = turns.withColumn("_block", block)
    return common.running_total(held, ["conv_id"], "_block", ["turn", "said"], F.lit(1).cast("long"), "pos").drop("_block")


def shared_first_turns(conv_id: Column) -> Column:
    """How many first turns a rebuilt conversation takes from the first of its twenty."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame, ws: Workspace, family: int = 20) -> DataFrame:
    """Conversations of the shared kind: the first h turns of conversation c - c % 20 (none if it is absent), then c's own
    after its first h. Columns conv_id, depth (0 for the conversation itself, turns from 1), said, words, length.

    ``turns`` as ``placed`` gives them.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    own = ws.store(own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": shared_first_turns(F.col("conv_id"))}), "conversations")
    bases = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    conv = own.join(bases, "base", "left").withColumn("taken", taken)
    conv = conv.withColumn("length", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    conv = ws.store(conv, "lengths")
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < 3))
    first = first.select(F.col("conv_id").alias("base"), "pos", "said", "words")
    columns = ["conv_id", "depth", "said", "words", "length"]
    from_base = conv.filter("taken > 0").join(first, "base").filter("pos < taken").withColumn("depth", F.col("pos") + 1)
    after = turns.join(conv.drop("base"), "conv_id").filter("pos >= h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h") + 1)
    starts = conv.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("said"), F.lit(0).cast("long").alias("words"), "length")
    parts = [starts, from_base.select(*columns), after.select(*columns)]
    return reduce(DataFrame.unionByName, parts)


def as_they_are(turns: DataFrame) -> DataFrame:
    """Conversations of their own turns, in the columns of ``rebuilt``."""
    length = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    rows = turns.join(length, "conv_id").select("conv_id", (F.col("pos") + 1).alias("depth"), "said", "words", "length")
    return rows.unionByName(length.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("said"), F.lit(0).cast("long").alias("words"), "length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds ``key``, the hash of the turns up to this one. Sums along a conversation in two levels, stretch by stretch."""
    halves = []
    for seed in (1, 2):
        drawn = F.xxhash64(F.lit(seed), "depth", "said")
        halves += [drawn.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(drawn, 32)]
    hashed = turns.withColumns({s: F.when(F.col("depth") > 0, h).otherwise(F.lit(0)) for s, h in zip(SUMS, halves, strict=True)})
    hashed = hashed.withColumn("_cell", F.floor(F.col("depth") / TURNS_PER_CELL))
    cells = hashed.groupBy("conv_id", "_cell").agg(*[F.sum(s).alias(s) for s in SUMS])
    along = Window.partitionBy("conv_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = cells.select("conv_id", "_cell", *[(F.sum(s).over(along) - F.col(s)).alias(f"_{s}") for s in SUMS])
    inside = Window.partitionBy("conv_id", "_cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.withColumns({s: F.sum(s).over(inside) for s in SUMS}).join(before, ["conv_id", "_cell"])
    key = F.md5(F.concat_ws(",", "depth", *[F.col(s) + F.col(f"_{s}") for s in SUMS]))
    return summed.select(*turns.columns, key.alias("key"))


def chains(rows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The nodes (key, owner, depth, n_convs, words), and the turns of all owners as nodes: conv, depth, owner, up, length.

    ``owner`` and ``up`` are the owners of the node and of its parent. Of equal conversations only the smallest owns anything.
    """
    grouped = rows.groupBy("key").agg(
        F.min("conv_id").alias("owner"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("words").alias("words")
    )
    nodes = ws.store(grouped, "nodes")
    lasts = rows.filter("depth = length").select("key", "conv_id")
    owners = lasts.join(nodes.select("key", "owner"), "key").filter("owner = conv_id").select("conv_id")
    mine = rows.join(ws.store(owners, "owners"), "conv_id", "left_semi").select("key", F.col("conv_id").alias("conv"), "length")
    owned = ws.store(mine.join(nodes.select("key", "owner", "depth"), "key").select("conv", "depth", "owner", "length"), "owned")
    above = owned.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("up"))
    return nodes, ws.store(owned.join(above, ["conv", "depth"], "left"), "chains")


def local_sums(parent: np.ndarray, mass: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over the subtrees of a forest by centroid decomposition. ``parent`` is -1 at a top; ``mass`` is the weight of a
    node's subtree, more than that of any child."""
    size, parents, left = len(parent), parent.tolist(), mass.tolist()
    below: list[list[int]] = [[] for _ in range(size)]
    work = []
    for node, above in enumerate(parents):
        (work if above < 0 else below[above]).append(node)
    out = np.zeros_like(values)
    while work:
        top = work.pop()
        whole, path = left[top], [top]
        while (heavy := next((x for x in below[path[-1]] if 2 * left[x] > whole), None)) is not None:
            path.append(heavy)
        centroid = path[-1]
        inside = [centroid]
        for node in inside:
            inside += below[node]
        # The component's total below the centroid goes to the path from it to the top.
        out[path] += values[inside].sum(axis=0)
        work += below[centroid]
        below[centroid] = []
        if centroid != top:
            below[path[-2]].remove(centroid)
            for node in path[:-1]:
                left[node] -= left[centroid]
            work.append(top)
    return out


def _solved(forest: DataFrame, sums: Sequence[str], groups: int) -> DataFrame:
    """Subtree sums of components that each fit a task, many to a group."""
    schema = ", ".join(["owner long", "depth long", *[f"{s} long" for s in sums]])
    names = list(sums)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        at = {node: k for k, node in enumerate(zip(part["owner"].tolist(), part["depth"].tolist(), strict=True))}
        ends = zip(part["up"].tolist(), part["depth"].tolist(), part["top"].tolist(), part["top_depth"].tolist(), part["owner"].tolist(), strict=True)
        parent = [-1 if (owner, depth) == (top, top_depth) else at[int(up), depth - 1] for up, depth, top, top_depth, owner in ends]
        found = local_sums(np.array(parent, np.int64), part["mass"].to_numpy(), part[names].to_numpy(np.int64))
        out = part[["owner", "depth"]].copy()
        out[names] = found
        return out

    return forest.withColumn("_group", F.pmod(F.xxhash64("top", "top_depth"), F.lit(groups))).groupBy("_group").applyInPandas(solve, schema)


def rollup(tree: DataFrame, ancestors: DataFrame, sums: Sequence[str], ws: Workspace, local: int = LOCAL) -> DataFrame:
    """Per node (owner, depth) the ``sums`` over its subtree.

    ``tree`` has owner, depth, up (the parent's owner), mass, and the numbers to sum; ``ancestors`` is ``chains``'
    second frame. Each round is stored. Components leave for a task of their own once they have at most
    ``local`` nodes; the heaviest left halves by the round.
    """
    comp = ["top", "top_depth"]
    top = tree.filter("up is null").select("owner", "depth").first()
    if top is None:
        return tree.select("owner", "depth", *sums)
    now = ws.store(tree.withColumns({"top": F.lit(top.owner).cast("long"), "top_depth": F.lit(top.depth).cast("long")}), "forest-0")
    small, added, k = [], [], 0
    below = ancestors.select(F.col("conv").alias("owner"), (F.col("depth") - 1).alias("c_depth"), F.col("owner").alias("head"), F.col("up").alias("head_up"))
    while True:
        sizes = ws.store(now.groupBy(*comp).agg(F.count("*").alias("n"), F.max("mass").alias("whole")), f"sizes-{k}")
        small.append(ws.store(now.join(sizes.filter(F.col("n") <= local).select(*comp), comp, "left_semi"), f"small-{k}"))
        big = sizes.filter(F.col("n") > local)
        if big.isEmpty():
            break
        part = now.join(big, comp)
        deepest = F.min_by(F.struct(F.col("owner").alias("c_owner"), F.col("depth").alias("c_depth"), F.col("mass").alias("c_mass")), "mass")
        centroids = ws.store(part.filter("2 * mass > whole").groupBy(*comp).agg(deepest.alias("c")).select(*comp, "c.*"), f"centroids-{k}")
        # A node deeper than the centroid is below it if its own conversation passes the centroid.
        met = part.join(centroids, comp).join(below, ["owner", "c_depth"], "left")
        under = F.coalesce((F.col("depth") > F.col("c_depth")) & (F.col("head_up") == F.col("c_owner")), F.lit(False))
        is_centroid = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
        met = ws.store(met.withColumns({"under": under, "is_centroid": is_centroid}), f"met-{k}")
        totals = met.filter("under or is_centroid").groupBy(*comp).agg(*[F.sum(s).alias(s) for s in sums])
        steps = centroids.join(totals, comp).withColumn("depth", F.explode(F.sequence("top_depth", "c_depth")))
        along = steps.join(ancestors.select(F.col("conv").alias("c_owner"), "depth", "owner"), ["c_owner", "depth"])
        path = ws.store(along.select("owner", "depth", *sums, "c_mass"), f"added-{k}")
        added.append(path.select("owner", "depth", *sums))
        less = path.select("owner", "depth", F.col("c_mass").alias("less"))
        rest = met.filter("not is_centroid").drop("c_mass").join(less, ["owner", "depth"], "left").select(
            "owner", "depth", "up", (F.col("mass") - F.coalesce("less", F.lit(0))).alias("mass"), *sums,
            F.when(F.col("under"), F.col("head")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
        now = ws.store(rest, f"forest-{k + 1}")
        ws.drop(f"met-{k}", f"forest-{k}", f"sizes-{k}")
        k += 1
    forest = reduce(DataFrame.unionByName, small)
    groups = max(1, forest.count() // (4 * local))
    parts = [*added, _solved(forest, sums, groups)]
    return reduce(DataFrame.unionByName, parts).groupBy("owner", "depth").agg(*[F.sum(s).alias(s) for s in sums])


def ending(rows: DataFrame) -> DataFrame:
    """Per node that conversations end at: key and the SHA-256 of their ids, ascending, joined by commas.

    The digest runs over a node's ids in order, in one task as SHA-256 has to, but the ids arrive as texts of up to
    IDS_PER_CHUNK and are not held.
    """
    ids = rows.filter("depth = length").select("key", "conv_id", F.floor(F.col("conv_id") / IDS_PER_CHUNK).alias("chunk"))
    chunks = ids.groupBy("key", "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "ends"])

    parts = common.partitions(rows.sparkSession)
    return chunks.repartition(parts, "key").sortWithinPartitions("key", "chunk").mapInArrow(run, "key string, ends string")


def trie(spark: SparkSession, rows: DataFrame, ws: Workspace, local: int = LOCAL) -> DataFrame:
    """Every node of the trie of conversations as ``rebuilt`` or ``as_they_are`` give them.

    Columns conv_id (the smallest conversation with this prefix), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (words of last turns that need not be repeated, over
    the subtree) and ends_sha256. Two different prefixes are one node only if 128 bits of their sums agree. No conversation, no
    node.
    """
    common.small_batches(spark)
    rows = ws.store(prefixes(rows), "prefixes")
    nodes, owned = chains(rows, ws)
    mass = owned.groupBy("owner", "depth").agg(F.sum(F.col("length") - F.col("depth") + 1).alias("mass"))
    own = owned.filter("conv = owner").select("owner", "depth", "up")
    children = own.filter("up is not null").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    at = ["owner", "depth"]
    tree = nodes.join(own, at).join(mass, at).join(children, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaf = (F.col("n_children") == 0).cast("long")
    tree = ws.store(tree.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "tree")
    sums = ["n_leaves", "saved_tokens"]
    found = rollup(tree.select(*at, "up", "mass", *sums), owned, sums, ws, local)
    named = tree.drop(*sums).join(found, at).join(ending(rows), "key", "left")
    return named.select(
        F.col("owner").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def shared_trie(spark: SparkSession, conversations: DataFrame, ws: Workspace, local: int = LOCAL) -> DataFrame:
    """The trie of rebuilt conversations (see ``rebuilt``) of a table of conv_id, turn, role and text.

    Turns go by turn, null first, equal ones by a hash of role and text; null roles and texts are empty; rows without a
    conv_id go; repeated rows are turns of their own. Other columns are ignored.
    """
    turns = ws.store(placed(ws.store(said(conversations), "said")), "turns")
    return trie(spark, rebuilt(turns, ws), ws, local)
