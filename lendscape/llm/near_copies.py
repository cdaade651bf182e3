"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash through Golay keys. Every shingle votes on SEGMENTS * 23 bits. A pair at the threshold
differs in about 15% of them, too many for whole segments to be equal or within the code's reach; so a segment is
decoded from the votes themselves to the codeword that they follow most, on which such a pair agrees one time in four. A key
joins the codewords of a few segments: more segments the more documents there are, so that strangers
seldom share one, and more keys the more segments, so that a pair at the threshold is met nine times in ten and a
closer one all but always (``recall`` in the tests).

Who shares a key is compared, never pair by pair: members are taken in turn, those near a leader belong to it, the
others are leaders themselves, and every member is compared with all leaders. Fingerprints rule out most, the
rest are compared on their shingles, so every link is verified. A crowd is cut into blocks first, whose leaders meet again.
A first pass over some of the keys takes most copies out; the heads of the components meet once more over all keys, until
that finds no new link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common, golay
from lendscape.llm.components import components
from lendscape.session import Workspace

SHINGLE_WORDS = 5
# Similarity of at least 4 / 5, in whole numbers.
NEAR = (4, 5)
SEED = 42
SEGMENTS = 32
WORDS = -(-SEGMENTS * golay.BITS // 64)
# Strangers that share a key, on average, at most.
LOAD = 1 / 64
# How many keys of so many segments. Beyond 10^9 documents strangers share more keys than LOAD says.
KEYS = {2: 64, 3: 512}
# The share of the keys that the first pass looks at; the others look at all of them.
FIRST = 0.25
# Bits in which near copies may differ, as a share: their 15% and, for short texts, over four deviations more.
FARTHEST = 0.27
# Up to so many who share a key are told apart by their fingerprints alone, before their shingles travel.
COMPANY = 1024
# Shingles that a task holds of one block.
BLOCK = 1 << 21
VOTES = 255


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted. Fewer words than a shingle has are one shingle; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[k:] for k in range(SHINGLE_WORDS)), strict=False)
    found = {xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in runs} or {xxhash.xxh64_intdigest(b" ".join(words), SEED)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Two texts without words are copies of each other."""
    if NEAR[1] * min(len(a), len(b)) < NEAR[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def votes(found: np.ndarray) -> np.ndarray:
    """Per bit, by how many shingles those for 1 outnumber those for 0."""
    ones = np.zeros(64 * WORDS, np.int64)
    salts = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(found), VOTES):
        drawn = found[at : at + VOTES, None] + salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            drawn = (drawn ^ (drawn >> np.uint64(shift))) * np.uint64(factor)
        drawn ^= drawn >> np.uint64(31)
        # No more votes at a time than a byte can count.
        ones += np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * ones - len(found))[: SEGMENTS * golay.BITS]


def segments_for(classes: int) -> int:
    """Segments to a key, so that strangers share one LOAD times on average."""
    return min(max(2, math.ceil(math.log(max(classes, 1) / LOAD) / math.log(4096))), max(KEYS))


@cache
def combinations(segments: int) -> np.ndarray:
    """The segments of each key, all used about equally often."""
    rng = np.random.default_rng(SEED)
    chosen: list[tuple[int, ...]] = []
    while len(chosen) < KEYS[segments]:
        order = rng.permutation(SEGMENTS)
        chosen += [tuple(sorted(order[k : k + segments])) for k in range(0, SEGMENTS - segments + 1, segments)]
        chosen = list(dict.fromkeys(chosen))
    return np.array(chosen[: KEYS[segments]])


def keys(sums: np.ndarray, segments: int) -> np.ndarray:
    """Signed 64-bit keys, a row of them per row of votes. 12 bits a segment and 12 for which they are fit one number."""
    codes = np.stack([golay.nearest(sums[:, k * golay.BITS : (k + 1) * golay.BITS]) for k in range(SEGMENTS)], axis=1)
    combined = np.zeros((len(sums), KEYS[segments]), np.int64)
    for part in combinations(segments).T:
        combined = combined << 12 | codes[:, part]
    return combined << 12 | np.arange(KEYS[segments])


def digest() -> Column:
    """Rows of one text are one class."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _entries(docs: DataFrame, segments: int) -> DataFrame:
    """A row per class: digest, first (the smallest doc_id), how many rows it has, bits (the fingerprint) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([votes(shingles(t)) for t in batch.column(2).to_pylist()], np.int64).reshape(batch.num_rows, -1)
            bits = [row.tobytes() for row in np.packbits(sums > 0, axis=1)]
            found = pa.array(keys(sums, segments).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits, pa.binary()), found], names=["digest", "doc_id", "bits", "keys"])

    named = docs.select(digest().alias("digest"), F.col("doc_id").cast("long"), "text")
    found = named.mapInArrow(run, "digest binary, doc_id long, bits binary, keys array<long>")
    same = [F.any_value(c).alias(c) for c in ("bits", "keys")]
    return found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), *same)


def _with_company(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Of those who share a key, leaves out who is far from all others there. Crowds stay whole."""
    most = FARTHEST * SEGMENTS * golay.BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, bits = None, [], []

        def done() -> pa.RecordBatch:
            kept = []
            if len(nodes) > 1:
                held = np.frombuffer(b"".join(bits), np.uint8).reshape(len(nodes), -1)
                kept = [n for k, n in enumerate(nodes) if (np.bitwise_count(held ^ held[k]).sum(axis=1, dtype=np.int64) <= most).sum() > 1]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(kept), pa.int64()), pa.array(kept, pa.int64())], names=["key", "node"])

        for batch in batches:
            out = []
            for key, node, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    out.append(done())
                    now, nodes, bits = key, [], []
                nodes.append(node)
                bits.append(found)
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        yield done()

    parts = common.partitions(members.sparkSession)
    few = members.filter(F.col("n") <= COMPANY).join(entries.select("node", "bits"), "node").select("key", "node", "bits")
    near = few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, node long")
    return near.unionByName(members.filter(F.col("n") > COMPANY).select("key", "node"))


def _sets(texts: DataFrame) -> DataFrame:
    """node, bits, n and the shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            n = pa.array([len(f) for f in found], pa.int64())
            held = pa.array([f.tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n, held], names=["node", "bits", "n", "held"])

    return texts.select("node", "bits", "text").mapInArrow(run, "node long, bits binary, n long, held binary")


def led_by(nodes: Sequence[int], bits: np.ndarray, sets: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """Links (leader, member) among those who share a key, in the order given."""
    most = FARTHEST * SEGMENTS * golay.BITS
    leaders, others, links = [], [], []

    def close(k: int, among: list[int]) -> Iterator[int]:
        apart = np.bitwise_count(bits[among] ^ bits[k]).sum(axis=1, dtype=np.int64)
        return (among[j] for j in np.flatnonzero(apart <= most).tolist() if near(sets[among[j]], sets[k]))

    for k in range(len(nodes)):
        (leaders if not leaders or next(close(k, leaders), None) is None else others).append(k)
    for k in others:
        links += [(nodes[leader], nodes[k]) for leader in close(k, leaders)]
    return links


def _met(rows: DataFrame) -> DataFrame:
    """Links a, b of the groups in ``rows``: grp, node, bits, held, arriving sorted by (grp, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, bits, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            links = led_by(nodes, np.array(bits, np.uint8).reshape(len(nodes), -1), sets) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for grp, node, found, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != now:
                    yield done()
                    now, nodes, bits, sets = grp, [], [], []
                nodes.append(node)
                bits.append(np.frombuffer(found, np.uint8))
                sets.append(np.frombuffer(held, np.uint64))
        yield done()

    return rows.select("grp", "node", "bits", "held").mapInArrow(run, "a long, b long")


def _pass(members: DataFrame, sets: DataFrame, ws: Workspace, name: str) -> list[DataFrame]:
    """Links found by the keys of ``members`` (key, node); each frame is stored.

    A key's members are compared in blocks. Where there are several, their leaders meet again in fewer blocks,
    until one is left; where a round leaves over half of them, unlike as they are, its blocks are compared two by two.
    """
    parts = common.partitions(members.sparkSession)
    sized = members.join(sets.select("node", "n"), "node")
    found, k, whole = [], 0, False
    while True:
        held = sized.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.col("n") + 8).alias("held")).filter("m > 1")
        cut = sized.join(held, "key").withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
        cut = ws.store(cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), f"{name}-cut-{k}")
        if whole:
            dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            grp = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        else:
            dealt, grp = cut, F.xxhash64("key", "own")
        ready = dealt.select(grp.alias("grp"), "node").join(sets.select("node", "bits", "held"), "node")
        links = ws.store(_met(ready.repartition(parts, "grp").sortWithinPartitions("grp", "node")), f"{name}-links-{k}")
        found.append(links)
        crowds = cut.filter("blocks > 1")
        before = 0 if whole else crowds.count()
        if not before:
            return found
        sized = ws.store(crowds.select("key", "node", "n").join(links.select(F.col("b").alias("node")).distinct(), "node", "left_anti"), f"{name}-rest-{k}")
        whole = 2 * sized.count() > before
        k += 1


def stars(links: DataFrame) -> DataFrame:
    """Fewer links that reach the same: a member and its leaders are all linked to the least of these.

    A member has a few leaders for each key, near ones at that, however many members they have; but a leader's name
    comes once for every member, so what is left are about as many links as nodes.
    """
    led = links.filter("a != b").groupBy("b").agg(F.collect_set("a").alias("every")).withColumn("least", F.array_min("every"))
    ends = F.explode(F.array_append("every", F.col("b")))
    return led.select(F.col("least").alias("a"), ends.alias("b")).filter("a != b").distinct()


def heads(spark: SparkSession, docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Two frames: ``classes``, the different texts (digest, node, first: their smallest doc_id, rows), and per node of a
    component of near copies its ``head``, the node with the smallest doc_id.

    Every node is linked to its head by verified links, and no two heads are near, but for those that share no key.
    """
    common.small_batches(spark)
    segments = segments_for(docs.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0])
    entries = ws.store(_entries(docs, segments).withColumn("node", F.monotonically_increasing_id()), "entries")
    classes = entries.select("digest", "node", "first", "rows")
    keyed = entries.select(F.explode("keys").alias("key"), "node")
    shared = ws.store(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    # Few keys are shared: the others do not travel a second time, and the few are read by both branches.
    crowded = common.perhaps_in(keyed, shared, "key", "asked").filter("asked").drop("asked").join(shared, "key")
    members = ws.store(_with_company(ws.store(crowded, "crowded"), entries), "members")
    # Stored, so that the planner sees whether they are few.
    candidates = ws.store(entries.select("digest", "node", "bits").join(members.select("node").distinct(), "node", "left_semi"), "candidates")
    # Few texts are candidates: the others do not travel.
    asked = common.perhaps_in(docs.select(digest().alias("digest"), "text"), candidates, "digest", "asked").filter("asked").drop("asked")
    texts = asked.join(candidates, "digest").dropDuplicates(["node"])
    sets = ws.store(_sets(texts), "sets")
    now, k = members.filter(F.col("key").bitwiseAND(0xFFF) < FIRST * KEYS[segments]), 0
    # An empty range starts no Python workers, an empty list does.
    led = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("head"))
    while True:
        fresh = _pass(now, sets, ws, f"pass-{k}")
        if k and reduce(DataFrame.unionByName, fresh).isEmpty():
            return classes, led
        # Nodes hold to the heads they have: the links that led there are not looked at again.
        links = reduce(DataFrame.unionByName, [*fresh, led.select(F.col("head").alias("a"), F.col("node").alias("b"))])
        named = components(stars(links), ws, f"components-{k}").join(classes, "node")
        least = F.min(F.struct(F.col("first").isNull(), "first", F.col("node").alias("head"))).alias("h")
        head = named.groupBy("label").agg(least).select("label", "h.head")
        led = ws.store(named.join(head, "label").select("node", "head"), f"led-{k}")
        now = members.join(led.filter("node != head"), "node", "left_anti").select("key", "node")
        k += 1
