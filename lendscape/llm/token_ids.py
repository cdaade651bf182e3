"""Token ids in binary shards: frequency ranks in bytes of variable number, control bytes apart.

A shard holds consecutive documents. Its ids are replaced by their rank among the shard's own token
counts (ties by id), so the frequent ones take one byte. Four ranks share a control byte, two bits each for
the number of bytes; data bytes follow in a stream of their own. Both are decoded with table lookups on
whole arrays: the control byte gives the lengths of its four ranks and how far its group reaches.

Layout, little-endian: magic, then u64 counts of documents, vocabulary entries, control bytes and data
bytes; per document doc_id i64, is-null u8, number of ids u64, first data byte u64; vocabulary u32 by rank;
control bytes; data bytes. A document's control bytes begin at a byte of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.llm.tokens import byte_encoder
from lendscape.session import Workspace

MAGIC = b"RANKVB01"
END_ID = 2
SHARD_IDS = 1 << 24
DECODE_AT_ONCE = 1 << 20
CONTROL = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
LENGTHS = (CONTROL + 1).astype(np.int64)
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
REACH = LENGTHS.sum(1)


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of whole groups of four ranks (u32)."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control, ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]


def unpack(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks of whole groups; ``data`` begins with the first group's bytes."""
    reach = REACH[control]
    at = ((np.cumsum(reach) - reach)[:, None] + STARTS[control]).ravel()
    length = LENGTHS[control].ravel()
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        out[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_shard(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """One shard of documents and their ids."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    n = np.bincount(joined, minlength=1)
    seen = np.flatnonzero(n)
    vocabulary = seen[np.argsort(-n[seen], kind="stable")].astype("<u4")
    rank = np.zeros(len(n), np.uint32)
    rank[vocabulary] = np.arange(len(vocabulary), dtype=np.uint32)
    padded = (counts + 3) // 4 * 4
    first = np.cumsum(padded) - padded
    ranks = np.zeros(int(padded.sum()), np.uint32)
    place = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(joined))
    ranks[place] = rank[joined]
    control, data = pack(ranks)
    ends = np.concatenate([[0], np.cumsum(REACH[control])])
    index = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        counts.astype("<u8").tobytes(), ends[first // 4].astype("<u8").tobytes(),
    ]
    head = np.array([len(ids), len(vocabulary), len(control), len(data)], "<u8").tobytes()
    return b"".join([MAGIC, head, *index, vocabulary.tobytes(), control.tobytes(), data.tobytes()])


def from_shard(blob: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a shard and their ids (u32), decoded some at a time."""
    if blob[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, v, c, d = (int(x) for x in np.frombuffer(blob, "<u8", 4, 8))
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, absent, counts, begins = take("<i8", n), take("u1", n), take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
    vocabulary, control, data = take("<u4", v), take("u1", c), take("u1", d)
    groups = (counts + 3) // 4
    first = np.cumsum(groups) - groups
    ends = np.cumsum(counts)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - counts[low] + DECODE_AT_ONCE)))
        g0, g1 = int(first[low]), int(first[high - 1] + groups[high - 1])
        stop = int(begins[high]) if high < n else d
        ranks = unpack(control[g0:g1], data[int(begins[low]) : stop])
        for k in range(low, high):
            own = ranks[4 * (first[k] - g0) : 4 * (first[k] - g0) + counts[k]]
            yield None if absent[k] else int(doc_ids[k]), vocabulary[own]
        low = high


def write_shards(docs: DataFrame, folder: str, parts: int, tokenizer: str = "byte_bpe_50k.json", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write; returns the manifest: a row (part, nth, path, n_docs, n_ids) per shard.

    Ranges of doc_id go to one task each, in ascending order, nulls first. A shard ends after
    ``shard_ids`` ids, so a task holds no more than one. Only files that the manifest names count: one
    that a lost task left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, nth = byte_encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{nth:04d}-{uuid.uuid4().hex}.ids"
            common.write_file(path, to_shard(names, ids))
            row = [[part], [nth], [path], [len(ids)], [held]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "nth", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(doc_id)
                ids.append(np.append(encode(text or ""), np.uint32(END_ID)).astype(np.uint32))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield flush()
                    names, ids, held, nth = [], [], 0, nth + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, "part long, nth long, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame, parts: int) -> DataFrame:
    """Per document, decoded from the files: doc_id, start in the whole, n_tokens, crc32 of the ids.

    The manifest has a row per shard; only those pass through one task, to place shards behind each other.
    """
    along = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = manifest.select("path", (F.sum("n_ids").over(along) - F.col("n_ids")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [[], [], [], []]
                for doc_id, ids in from_shard(common.read_file(path)):
                    for column, value in zip(out, (doc_id, base, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        column.append(value)
                    base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """Write every text, read every file back. A null text is empty: its end id alone.

    Repeated rows and equal doc_ids are documents of their own, in the order of their texts; a null
    doc_id comes first. No documents give no files and no rows. Other columns are ignored.
    """
    common.small_batches(spark)
    parts = common.partitions(spark)
    manifest = ws.store(write_shards(docs, ws.folder("shards"), parts), "manifest")
    return read_shards(manifest, parts)
