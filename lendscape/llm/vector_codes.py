"""Vector codes by product quantisation, each part's nearest entry found in a GNAT over the codebook.

Components become whole numbers, so distances are whole numbers and every run has the same codes. A vector is cut into
equal parts, and each part position has a codebook that a few rounds of k-means move.

A GNAT (geometric near-neighbour access tree) holds a codebook's entries: a node has split points, every
other entry belongs to the nearest of them, and each split point knows the range of its distances to the
entries of every child. With the best distance so far, r, a query at distance d from a split point can rule out a child
whose range lies wholly outside [d - r, d + r]. Only strictly worse subtrees go, with a margin for the rounding of the
square roots; what is left is compared on whole numbers, ties to the lower index.

A codebook is no larger than ENTRIES vectors, so it travels with the task. Tasks give back sums per entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
DEGREE = 16
# Components a task holds at once.
HELD = 1 << 18
# Larger components are held at this bound: whole numbers that a double still tells apart.
BOUND = 1 << 53
LONGEST = (1 << 63) - 1
MARGIN = 1e-9


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, row against row: exact in doubles below 2^53, in Python numbers whatever they are."""
    own, others = (queries * queries).sum(axis=1), (points * points).sum(axis=1)
    return own[:, None] + others[None, :] - 2 * (queries @ points.T)


@dataclass
class Node:
    """``points`` are entries: all of a leaf's, or the split points, whose other entries are in ``children``."""

    points: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


class Gnat:
    """Nearest entry of one codebook. ``entries``: a row each, whole numbers."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.degree, self.compared = entries, degree, 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> Node:
        if len(members) <= self.degree:
            return Node(members)
        # Split points far from each other: each is the farthest from those before it.
        far = squared(self.entries[members], self.entries[members[:1]])[:, 0]
        picked = [0]
        while len(picked) < self.degree and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, squared(self.entries[members], self.entries[members[picked[-1:]]])[:, 0])
        splits = members[picked]
        if len(splits) == 1:
            # All are equal: the lowest index is the answer for every query.
            return Node(members[:1])
        distance = squared(self.entries[members], self.entries[splits])
        owner = distance.argmin(axis=1)
        owner[picked] = np.arange(len(picked))
        root = np.sqrt(distance.astype(np.float64))
        low, high, children = np.zeros((len(splits),) * 2), np.zeros((len(splits),) * 2), []
        for j in range(len(splits)):
            mine = owner == j
            low[:, j], high[:, j] = root[mine].min(axis=0), root[mine].max(axis=0)
            mine[picked[j]] = False
            children.append(self._node(members[mine]) if mine.any() else None)
        return Node(splits, low, high, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each query, of equal ones the lowest index."""
        index = np.full(len(queries), len(self.entries), np.int64)
        best = np.full(len(queries), np.inf, object if queries.dtype == object else np.float64)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, index, best)
        return index, best

    def _visit(self, node: Node, rows: np.ndarray, queries: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        found = squared(queries[rows], self.entries[node.points])
        self.compared += found.size
        least = found.min(axis=1)
        at = np.where(found == least[:, None], node.points[None, :], len(self.entries)).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (at < index[rows]))
        index[rows[better]], best[rows[better]] = at[better], least[better]
        if not node.children:
            return
        away = np.sqrt(found.astype(np.float64))
        for j, child in enumerate(node.children):
            if child is None:
                continue
            radius = np.sqrt(best[rows].astype(np.float64))[:, None]
            slack = MARGIN * (1 + away + radius)
            worse = (away - radius > node.high[:, j] + slack) | (away + radius < node.low[:, j] - slack)
            left = rows[~worse.any(axis=1)]
            if len(left):
                self._visit(child, left, queries, index, best)


def exact(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where squared distances stay below 2^53, else Python numbers."""
    largest = max((int(np.abs(a).max()) for a in (parts, books) if a.size), default=0)
    dtype = np.float64 if 4 * largest * largest * max(parts.shape[-1], 1) < BOUND else object
    return parts.astype(dtype), books.astype(dtype)


class Coder:
    """A task's search trees for one state of the codebooks (part, entry, position)."""

    def __init__(self, books: np.ndarray):
        self.books, self.trees = books, {}

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance per vector and part."""
        exactly, books = exact(parts, self.books)
        if books.dtype not in self.trees:
            self.trees[books.dtype] = [Gnat(b) for b in books]
        found = [tree.nearest(exactly[:, k]) for k, tree in enumerate(self.trees[books.dtype])]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _parts(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, width)


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label and ``parts``, floor(1024 * component): vectors that are null or hold null or non-finite components go.

    So do empty ones and those not to be cut into equal parts.
    """
    whole = F.col("embedding").cast("array<double>")
    fit = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = F.transform(whole, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("long"))
    kept = rows.filter(fit).filter((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    return kept.select(F.col("vec_id").cast("long"), "label", held.alias("parts"))


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean; unused ones stay."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums, counts = Coder(books), None, np.zeros(books.shape[:2], np.int64)
        for batch in common.regrouped(batches, max(1, HELD // max(PARTS, PARTS * width))):
            parts = _parts(batch.column(0), width)
            index, _ = coder.assign(parts)
            if sums is None:
                sums = np.zeros(books.shape, object)
            for p in range(PARTS):
                order = np.argsort(index[:, p], kind="stable")
                used, starts, n = np.unique(index[order, p], return_index=True, return_counts=True)
                # Sums of a batch's components, of at most 2^53 each, would overflow: halves are summed apart.
                high, low = parts[order, p] >> 27, parts[order, p] & ((1 << 27) - 1)
                high, low = (np.add.reduceat(half, starts, axis=0).astype(object) for half in (high, low))
                sums[p, used] += high * (1 << 27) + low
                counts[p, used] += n
        if sums is not None:
            part, entry = np.nonzero(counts)
            at = np.tile(np.arange(width, dtype=np.int32), len(part))
            totals = pa.array([str(x) for x in sums[part, entry].ravel()], pa.string())
            columns = [np.repeat(part.astype(np.int32), width), np.repeat(entry.astype(np.int32), width), at, np.repeat(counts[part, entry], width)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), totals], names=["part", "entry", "at", "n", "total"])

    found = kept.select("parts").mapInArrow(run, "part int, entry int, at int, n long, total string")
    sums = found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    moved = books.copy()
    # No more rows than the codebooks have components.
    for row in sums.toLocalIterator():
        moved[row.part, row.entry, row["at"]] = int(row.total) // row.n
    return moved


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """Part, entry, position. The first entries are the vectors of the smallest vec_ids; None without vectors.

    All vectors have the length of the first one here. Nothing but codebooks reaches the driver.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    if not first:
        return None
    books = np.array([r.parts for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(kept, books)
    return books


def encode(spark: SparkSession, rows: DataFrame, ws: Workspace, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all fit vectors (vec_id, label, ``entries`` per part, ``error``), and the codebooks.

    Left out are vectors that are null, empty, hold null or non-finite components, cannot be cut into equal parts, or differ in
    length from the one with the smallest vec_id (then smallest components). Components beyond 2^53 / 1024 are held there; an
    error beyond a long is its largest. Repeated rows are vectors of their own; a null vec_id comes last. Other
    columns are ignored. An empty table has no codes.
    """
    common.small_batches(spark)
    every = ws.store(whole_numbers(rows), "vectors")
    lead = every.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(1).select(F.size("parts")).collect()
    length = lead[0][0] if lead else 0
    kept = every.filter(F.size("parts") == length)
    books = codebooks(kept, rounds, entries)
    width = length // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books)
        for batch in common.regrouped(batches, max(1, HELD // max(PARTS, PARTS * width))):
            index, distance = coder.assign(_parts(batch.column(2), width))
            error = [min(int(e), LONGEST) for e in distance.sum(axis=1)]
            found = pa.array(index.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, pa.array(error, pa.int64())], names=["vec_id", "label", "entries", "error"])

    label = next(f.dataType.simpleString() for f in kept.schema.fields if f.name == "label")
    return kept.mapInArrow(run, f"vec_id long, label {label}, entries array<int>, error long"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and ``parts``, the whole-number vector that its code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column(1).flatten().to_numpy().reshape(-1, PARTS)
            vectors = np.concatenate([books[k][index[:, k]] for k in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors.tolist(), pa.list_(pa.int64()))], names=["vec_id", "parts"])

    common.ship(codes.sparkSession)
    return codes.select("vec_id", "entries").mapInArrow(run, "vec_id long, parts array<long>")


def coded(spark: SparkSession, rows: DataFrame, ws: Workspace) -> DataFrame:
    """Per fit vector: vec_id, code in hex, error, label_error (errors of the label together) and the digest of the codebooks."""
    codes, books = encode(spark, rows, ws)
    codes = ws.store(codes, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = ws.store(codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    code = F.concat(*[F.lower(F.lpad(F.hex(F.col("entries")[k]), 2, "0")) for k in range(PARTS)])
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books) if books is not None else None).alias("codebooks_sha256"))
