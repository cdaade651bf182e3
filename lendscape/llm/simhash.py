"""Near duplicates by 64-bit SimHash, found with fuzzy hashing by the binary Golay code.

The (23, 12) Golay code is perfect: every 23-bit word has exactly one codeword within three bits.
A word and its one-bit neighbours decode to at most six codewords, so two words that differ in at
most one bit share a key: each one's own codeword is among the other's six.

A fingerprint is cut into segments of 22, 21 and 21 bits. At most three differing bits leave one of

* a segment without error and another with at most one: key (segment as it is, codeword of the other),
  for the six ordered pairs of segments;
* one error in each segment: key (codewords of all three), where one side offers its own codewords for
  the first two and all neighbours of the third, the other side the reverse.

Every link within three bits is met by one of these keys of 33 to 36 bits, and each is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common, near_copies
from lendscape.llm.components import components
from lendscape.llm.golay import GENERATOR
from lendscape.session import Workspace

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
WIDTHS = (22, 21, 21)
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint: a bit is set where over half the shingle hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[k:] for k in range(width)), strict=False)] or [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at : at + SHINGLES_AT_ONCE]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each of the 2048 syndromes."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [syndrome(1 << b) for b in range(23)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.uint16)
        for k, s in enumerate(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ s
        return out

    leader = np.zeros(2048, np.uint32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            leader[s] = sum(1 << b for b in bits)
    return table(single[:12]), table(single[12:]), leader


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword within three bits of each 23-bit word."""
    low, high, leader = _tables()
    return ((words ^ leader[low[words & 0xFFF] ^ high[words >> 12]]) >> 11).astype(np.int64)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for width in WIDTHS:
        out.append((fps >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint32))
        shift += width
    return out


def _neighbours(segment: np.ndarray, width: int) -> np.ndarray:
    """Six columns: the distinct codewords of a segment and its one-bit neighbours, -1 where fewer."""
    flips = np.array([0, *(1 << b for b in range(width))], np.uint32)
    keys = np.sort(codeword(segment[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    out = np.full((len(segment), 6), -1, np.int64)
    row, _ = np.nonzero(fresh)
    out[row, (np.cumsum(fresh, axis=1) - 1)[fresh]] = keys[fresh]
    return out


def keys(fps: np.ndarray, offering: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys. ``offering``: 12 keys a fingerprint at most, else the up to 72 that ask for them."""
    segments = _segments(fps)
    own = [codeword(s)[:, None] for s in segments]
    near = [_neighbours(s, w) for s, w in zip(segments, WIDTHS, strict=True)]
    blocks = []
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        fuzzy = (own if offering else near)[j]
        exact = segments[i].astype(np.int64)[:, None]
        blocks.append(np.where(fuzzy >= 0, tag << 36 | exact << 12 | fuzzy, -1))
    a, b, c = (own[0], own[1], near[2]) if offering else (near[0], near[1], own[2])
    joint = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    valid = (a[:, :, None, None] >= 0) & (b[:, None, :, None] >= 0) & (c[:, None, None, :] >= 0)
    blocks.append(np.where(valid, 6 << 36 | joint, -1).reshape(len(fps), -1))
    table = np.concatenate(blocks, axis=1)
    row, column = np.nonzero(table >= 0)
    return row, table[row, column]


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit number. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, parts: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column ``fp``, each once) that differ in at most ``most_bits`` <= 3 bits."""
    if most_bits > 3:
        raise ValueError("the segment keys meet every link of up to three bits only")

    def keyed(offering: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column(0).to_numpy()
                for at in range(0, len(fps), 4096):
                    part = fps[at : at + 4096]
                    row, found = keys(part.view(np.uint64), offering)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[row])], names=["key", "fp"])

        return run

    spread = prints.select("fp").repartition(parts, "fp")
    offered = spread.mapInArrow(keyed(True), "key long, fp long").withColumnRenamed("fp", "a")
    asked = spread.mapInArrow(keyed(False), "key long, fp long").withColumnRenamed("fp", "b")
    near = (offered["a"] < asked["b"]) & (F.bit_count(offered["a"].bitwiseXOR(asked["b"])) <= most_bits)
    # The planner sizes either side by the fingerprints it is made from, not by up to 84 keys for each, and would broadcast it.
    return offered.join(asked.hint("merge"), (offered["key"] == asked["key"]) & near).select("a", "b").distinct()


def near_duplicates(
    spark: SparkSession, docs: DataFrame, ws: Workspace, width: int = SHINGLE_WORDS, most_bits: int = MOST_BITS
) -> DataFrame:
    """Per document its fingerprint (16 hex digits) and component: the smallest doc_id reachable by links.

    Documents of one fingerprint are one class, however many they are; only classes are linked.
    Texts without words share the fingerprint zero, which links like any other. A row without a doc_id
    keeps its place in the result and names no component unless nothing else does (then null). Repeated
    rows stay repeated. Other columns are ignored.
    """
    common.small_batches(spark)
    found = ws.store(fingerprints(docs, width), "fingerprints")
    classes = ws.store(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    pairs = ws.store(links(classes, common.partitions(spark), most_bits), "links")
    label = ws.store(components(pairs, ws), "labels")
    linked = classes.join(label, classes["fp"] == label["node"]).select("fp", "first", "label")
    heads = linked.groupBy("label").agg(F.min("first").alias("head"))
    named = linked.join(heads, "label").select("fp", "head")
    of_class = classes.join(named, "fp", "left").select("fp", F.coalesce("head", "first").alias("component_id"))
    # Stored, so that the last join stands alone: adaptive execution can split a crowd of one fingerprint there.
    of_class = ws.store(of_class, "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(of_class, "fp").select("doc_id", digits, "component_id")


def survivors(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """The documents that stay: of each component of near copies the one whose doc_id names it. A row without a doc_id stays.

    A fingerprint of 64 bits tells copies with hardly a word changed; which documents go is decided on shingles
    (see ``near_copies``). doc_id names a document; rows that repeat a doc_id and its text are one, rows that repeat
    a doc_id with another text are judged each by its own component. Columns stay as they are, whatever their names.
    """
    classes, led = near_copies.heads(spark, docs, ws)
    # Most texts have one row and no near copy: only the others are looked up, and the table of them is small.
    marked = classes.join(led, "node", "left").filter("rows > 1 or head is not null")
    names = {c: common.fresh(docs, f"_{c}") for c in ("digest", "first", "rows", "stays")}
    stays = F.coalesce(F.col("head") == F.col("node"), F.lit(True)).alias(names["stays"])
    marked = ws.store(marked.select(*[F.col(c).alias(names[c]) for c in ("digest", "first", "rows")], stays), "marked")
    key, first = names["digest"], F.col(names["first"])
    # So do the texts of the others not travel.
    asked = common.fresh(docs, "_asked")
    named = common.perhaps_in(docs.withColumn(key, near_copies.digest()), marked, key, asked)
    others = named.filter(~F.col(asked)).select(*docs.columns)
    named = named.filter(asked).drop(asked).join(marked, key, "left")
    own = F.col("doc_id").cast("long") == first
    kept = named.filter(F.col("doc_id").isNull() | F.col(names["stays"]).isNull() | (F.col(names["stays"]) & own))
    again = kept.filter((F.col(names["rows"]) > 1) & F.col("doc_id").isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = ws.store(again.select(key), "repeated")
    if repeated.isEmpty():
        return others.unionByName(kept.select(*docs.columns))
    once = kept.filter("doc_id is not null").join(repeated, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    rest = kept.filter("doc_id is not null").join(repeated, key, "left_anti").select(*docs.columns)
    kept = rest.unionByName(once).unionByName(kept.filter("doc_id is null").select(*docs.columns))
    return others.unionByName(kept)
