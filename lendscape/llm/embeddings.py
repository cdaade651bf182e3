"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are brought to length one, so a cosine of at least ``c`` is a distance of at most sqrt(2 - 2c).
A hash is floor((a.v + b) / w) with a Gaussian direction a and a shift b: near vectors mostly fall into the
same cell. K hashes make a key, and L tables of such keys make it all but certain that a link meets in
one of them. Where vectors meet they are compared by exact cosine in double precision.

Equal vectors are one class, compared once. A bucket is compared in blocks: a crowded one is cut into
blocks of about BLOCK vectors, each pair of blocks is a task's work of bounded size, and what leaves it
is a count per vector and one edge per vector, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.llm.components import components
from lendscape.session import Workspace

LEAST_COSINE = 0.95
WIDTH = 1.5
MISS = 0.01
BUCKET = 4
BLOCK = 512
SEED = 8


def collision(distance: float, width: float) -> float:
    """The chance that one hash puts two vectors this far apart into the same cell."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(classes: int, cosine: float = LEAST_COSINE, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """K and L: about BUCKET unrelated vectors to a bucket, and a link at the threshold missed at most that often."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(classes, 1) / BUCKET) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


@cache
def projections(dimension: int, k: int, tables: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts, drawn from the seed alone: every task has the same."""
    rng = np.random.default_rng((SEED, dimension))
    return rng.standard_normal((dimension, k * tables)), rng.uniform(0, width, k * tables)


def bucket_keys(vectors: np.ndarray, k: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """A 64-bit key per vector and table."""
    directions, shifts = projections(vectors.shape[1], k, tables, width)
    cells = np.floor((vectors @ directions + shifts) / width).astype(np.int64).reshape(len(vectors), tables, k).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cells.shape[:2]).copy()
        for j in range(k):
            key = (key ^ cells[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def linked(left: np.ndarray, right: np.ndarray, cosine: float = LEAST_COSINE) -> np.ndarray:
    """Which vectors of length one, row against row, reach the cosine in double precision."""
    return left @ right.T >= cosine


def _unit(batch: pa.Array) -> np.ndarray:
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, 0))
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # no over- or underflow in the squares
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _keyed(classes: DataFrame, dimension: int, k: int, tables: int) -> DataFrame:
    """A row per class and table: cid, tbl, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = bucket_keys(_unit(batch.column(1)), k, tables)
                cid = np.repeat(batch.column(0).to_numpy(), tables)
                tbl = np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(tbl), pa.array(found.ravel())], names=["cid", "tbl", "key"])

    return classes.filter(F.col("dim") == dimension).select("cid", "embedding").mapInArrow(run, "cid long, tbl int, key long")


def _compare(rows: DataFrame, k: int, tables: int, cosine: float) -> DataFrame:
    """Per class and comparison: how many vectors it links to (n), and the smallest class of those
    that the links of this comparison connect (least).

    ``rows`` arrive sorted by (grp, key, side, cid); those of one grp and key are compared: a block with
    itself (side 0), or one (side -1) with another (side 1). A pair that meets in several tables is
    counted in the first of them.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            grp, key = (batch.column(c).to_numpy() for c in ("grp", "key"))
            change = np.flatnonzero((grp[1:] != grp[:-1]) | (key[1:] != key[:-1]))
            first = held[0]
            same = first.column("grp")[0] == batch.column("grp")[0] and first.column("key")[0] == batch.column("key")[0]
            if len(change) or not same:
                cut = int(change[-1]) + 1 if len(change) else 0
                held[-1] = batch.slice(0, cut)
                yield pa.Table.from_batches(held)
                held = [batch.slice(cut)]
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            part = part.combine_chunks()
            vectors = _unit(part.column("embedding").combine_chunks())
            grp, key, cid, size, side, tbl = (part.column(c).to_numpy() for c in ("grp", "key", "cid", "size", "side", "tbl"))
            starts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (key[1:] != key[:-1])]))
            comparisons = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(grp)], strict=True):
                split = s if side[s] == 0 else s + int((side[s:e] < 0).sum())
                a, b = (slice(s, e), slice(s, e)) if side[s] == 0 else (slice(s, split), slice(split, e))
                hit = linked(vectors[a], vectors[b], cosine)
                if side[s] == 0:
                    np.fill_diagonal(hit, False)
                if hit.any():
                    comparisons.append((a, b, hit))
            some = np.zeros(len(grp), bool)
            for a, b, hit in comparisons:
                some[a] |= hit.any(axis=1)
                some[b] |= hit.any(axis=0)
            keys = np.zeros((len(grp), tables), np.int64)
            keys[some] = bucket_keys(vectors[some], k, tables)
            n, least = np.zeros(len(grp), np.int64), cid.copy()
            for a, b, hit in comparisons:
                i, j = np.nonzero(hit)
                hit[i, j] = (keys[a][i] == keys[b][j]).argmax(axis=1) == tbl[a.start]
                n[a] += hit @ size[b]
                if a != b:
                    n[b] += hit.T @ size[a]
                before = None
                while before is None or (before != least[a.start : b.stop]).any():
                    before = least[a.start : b.stop].copy()
                    least[a] = np.minimum(least[a], np.where(hit, least[b], least[a][:, None]).min(axis=1, initial=1 << 62))
                    least[b] = np.minimum(least[b], np.where(hit.T, least[a], least[b][:, None]).min(axis=1, initial=1 << 62))
            met = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(cid[met]), pa.array(n[met]), pa.array(least[met])], names=["cid", "n", "least"])

    return rows.mapInArrow(run, "cid long, n long, least long")


def _spanning(found: DataFrame) -> DataFrame:
    return found.filter("least < cid").select("cid", "least").distinct()


def near_duplicates(
    spark: SparkSession, rows: DataFrame, ws: Workspace, cosine: float = LEAST_COSINE, width: float = WIDTH
) -> DataFrame:
    """Per vector: n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors
    of different dimension never link. Repeated rows are vectors of their own and link with each other. A null
    vec_id names no component unless nothing else does. Other columns are ignored.
    """
    common.small_batches(spark, 4096)
    whole = F.col("embedding").cast("array<double>")
    fit = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(whole, lambda x: x != 0)
    named = rows.select(F.col("vec_id").cast("long"), whole.alias("embedding"), F.coalesce(fit, F.lit(False)).alias("fit"))
    # Adding 0.0 makes both zeros one; the digest of all components names the class.
    text = F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")))
    named = ws.store(named.withColumn("class", F.when(F.col("fit"), F.sha2(text, 256))), "vectors")
    grouped = named.filter("fit").groupBy("class").agg(
        F.min("vec_id").alias("head"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding")
    )
    classes = ws.store(
        grouped.select(F.monotonically_increasing_id().alias("cid"), "class", "head", "size", "embedding", F.size("embedding").alias("dim")), "classes"
    )
    parts = common.partitions(spark)
    found = None
    for row in sorted(classes.groupBy("dim").count().collect()):
        k, tables = parameters(row["count"], cosine, width)
        keyed = ws.store(_keyed(classes, row["dim"], k, tables), f"keys-{row['dim']}")
        many = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        cut = keyed.join(many, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        dealt = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select("cid", "tbl", "key", pair.alias("grp"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"))
        held = dealt.join(classes.select("cid", "size", "embedding"), "cid")
        ready = held.repartition(parts, "grp").sortWithinPartitions("grp", "key", "side", "cid")
        part = ws.store(_compare(ready, k, tables, cosine), f"met-{row['dim']}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "cid long, n long, least long")
    label = ws.store(components(_spanning(found), ws), "labels")
    counted = found.groupBy("cid").agg(F.sum("n").alias("n"))
    heads = classes.join(label, classes["cid"] == label["node"]).select("cid", "head", "label")
    top = heads.groupBy("label").agg(F.min("head").alias("top"))
    reached = heads.join(top, "label").select("cid", "top")
    of_class = (
        classes.join(counted, "cid", "left").join(reached, "cid", "left")
        .select("class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("top", "head").alias("component_id"))
    )
    out = named.join(of_class, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
