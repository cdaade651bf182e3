"""Best-fit packing whose bin counts are certified, or improved where they are not.

Texts become token ids with an end id, cut only where longer than a sequence. Pieces are dealt to
groups; each group packs best-fit decreasing and compares its bins with a lower bound from
dual-feasible functions: functions u with sum(u(x)) <= 1 for every set that fits one bin, so that the
sum of u over all pieces is never above the bins needed. A group that meets its bound is done. Those with
a gap exchange the pieces of bins that are not full, in fewer and larger groups, and pack again; the new
packing stands if it takes fewer bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.llm.tokens import word_encoder
from lendscape.session import Workspace

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 2048
# Groups that exchange are larger by this: more pieces to choose from.
EXCHANGE = 4
PACKED = "uid long, length long, grp long, bin long, offset long, n_bins long, bound long, left long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. A null text is its end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, value in zip(out, (doc_id, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of three families of dual-feasible functions over the pieces' lengths (1 to capacity)."""
    if not len(lengths):
        return 0
    x = np.arange(capacity + 1)
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 101):  # a piece counts as floor((k + 1) x) of k, or as itself where that is whole
        scaled = (k + 1) * x
        worth = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((worth * n).sum()) // (k * capacity)))
    count, total = np.cumsum(n), np.cumsum(x * n)
    e = np.arange(1, capacity // 2 + 1)  # over capacity - e: a bin; under e: nothing
    large = count[-1] - count[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for e in range(2, capacity // 2 + 1, 8):  # large pieces leave room for whole multiples of e only
        whole = capacity // e
        worth = np.where(2 * x > capacity, whole - (capacity - x) // e, x // e)
        worth = np.where(2 * x == capacity, whole / 2, worth)
        best = max(best, int(np.ceil((worth * n).sum() / whole - 1e-9)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and what stays free in each bin.

    Open bins are listed by free space; a bit per space that occurs finds the tightest fit at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    occurs = 0
    for k in order.tolist():
        length = int(lengths[k])
        fitting = occurs >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                occurs &= ~(1 << space)
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins[k], offsets[k] = b, capacity - space
        free[b] = space - length
        if free[b]:
            by_space[free[b]].append(b)
            occurs |= 1 << free[b]
    return bins, offsets, free


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
    lengths = rows["length"].to_numpy()
    bins, offsets, free = best_fit_decreasing(lengths)
    return pd.DataFrame({
        "uid": rows["uid"].to_numpy(), "length": lengths, "grp": rows["grp"].to_numpy(), "bin": bins, "offset": offsets,
        "n_bins": len(free), "bound": lower_bound(lengths), "left": np.asarray(free, np.int64)[bins],
    })


def _packed(rows: DataFrame, groups: int, salt: int) -> DataFrame:
    dealt = rows.select("uid", "length", F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInPandas(_pack_group, PACKED)


def pack(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per piece its sequence and its place there, gapless from 0.

    A null text is empty; repeated rows are packed each; a null doc_id is kept. Nothing gives nothing.
    Other columns are ignored. Groups are dealt by a hash of the row, about GROUP_PIECES rows each; those with a
    gap exchange until a round saves no sequence.
    """
    common.small_batches(spark)
    cut = ws.store(pieces(docs).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, cut.count() // GROUP_PIECES)
    current = ws.store(_packed(cut, groups, 0), "packed-0")
    done = []
    k = 1
    while True:
        # A bin can only be saved by filling others: those with free space are dissolved.
        gap = (F.col("n_bins") > F.col("bound")) & (F.col("left") > 0)
        done.append(current.filter(~gap).select("uid", F.lit(k - 1).alias("round"), "grp", "bin", "offset"))
        open_ = current.filter(gap)
        had, n = open_.select("grp", "bin").distinct().count(), open_.count()
        if not n:
            break
        groups = max(1, n // (EXCHANGE * GROUP_PIECES))
        again = ws.store(_packed(open_, groups, k), f"packed-{k}")
        if again.select("grp", "bin").distinct().count() >= had:
            done.append(open_.select("uid", F.lit(k - 1).alias("round"), "grp", "bin", "offset"))
            break
        current = again
        k += 1
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    number = F.shiftleft(F.col("round").cast("long"), 48) + F.shiftleft("grp", 16) + F.col("bin")
    return cut.join(placed.withColumn("sequence_id", number), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
