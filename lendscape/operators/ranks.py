"""Exact rank statistics per group (AUC, quantiles) without sorting a group in one task.

Both start from a histogram: one row per (group, value) with summed weights, stored because every
operator here passes over it more than once. The value axis is cut into slices of about equal row
count, and order is only established inside a (group, slice) cell; cells are then placed behind
each other by their totals. Slices are cut again until a cell holds about ``CELL_ROWS`` rows, so it
is the number of cells that grows with the data, not their size. The cuts come from sketches,
which decide how evenly work is spread and never what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscape.session import stored

SLICES = 64
CELL_ROWS = 1 << 17
# Cuts of slices are broadcast up to this level: 64 * 64 rows of 63 numbers, 2 MB.
BROADCAST_LEVELS = 3


def value_counts(df: DataFrame, by: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """One row per distinct value in each group; rows without a value are left out."""
    aggregates = [F.sum(c).alias(name) for name, c in sums.items()] or [F.count("*").alias("n")]
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggregates)


def histogram(df: DataFrame, by: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """``value_counts``, stored for repeated use."""
    return stored(value_counts(df, by, value, **sums), "histogram")


def cut_levels(hist: DataFrame, cell_rows: int = CELL_ROWS) -> int:
    """How often the axis has to be cut into ``SLICES`` until a slice holds at most ``cell_rows`` rows.

    Counts the rows, which for a stored histogram reads file footers only.
    """
    rows, levels = hist.count(), 0
    while rows > cell_rows * SLICES**levels:
        levels += 1
    return levels


def _cuts(axis: Column) -> Column:
    return F.percentile_approx(axis, [k / SLICES for k in range(1, SLICES)], 10 * SLICES)


def _slice_number(axis: Column, cuts: Column) -> Column:
    """Where the axis falls among the cuts; found by bisection, not by scanning."""

    def bisect(cuts: Column, lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(axis <= cuts[mid], bisect(cuts, lo, mid)).otherwise(bisect(cuts, mid + 1, hi))

    # Bound to one lambda variable, so that the plan holds what the cuts come from once.
    return F.transform(F.array(cuts), lambda found: bisect(found, 0, SLICES - 1))[0].cast("long")


def with_slice(hist: DataFrame, value: str, levels: int = 1) -> DataFrame:
    """Number the slice of the value axis each row lies in, in the order of the values.

    The first level cuts the axis over all rows of the histogram, every further one cuts each slice
    over the rows in it: no (group, slice) cell holds much more than one ``SLICES ** levels``-th of
    them, whatever the groups look like. A level is a scan with partial aggregation; rows stay where
    they are.
    """
    axis = F.col(value).cast("double")
    if levels == 0:
        return hist.withColumn("_slice", F.lit(0).cast("long"))
    sliced = hist.withColumn("_cuts", hist.agg(_cuts(axis)).scalar())
    sliced = sliced.withColumn("_slice", _slice_number(axis, F.col("_cuts"))).drop("_cuts")
    for level in range(2, levels + 1):
        cuts = sliced.groupBy("_slice").agg(_cuts(axis).alias("_cuts"))
        finer = F.col("_slice") * SLICES + _slice_number(axis, F.col("_cuts"))
        sliced = sliced.join(F.broadcast(cuts) if level <= BROADCAST_LEVELS else cuts, "_slice")
        sliced = sliced.withColumn("_slice", finer).drop("_cuts")
    return sliced


def grouped_auc(
    hist: DataFrame, by: Sequence[str], value: str, carry: Sequence[str] = (), cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Area under the ROC curve per group and its Gini, ties averaged, null where one class is absent.

    ``hist`` has the columns ``pos`` and ``neg``; columns in ``carry`` are summed along per group.
    AUC is the share of (positive, negative) pairs ranked right: each positive beats the negatives
    of lower values and half of those at its own. Inside a cell that needs a running sum of
    negatives; for the cells below, one total each.
    """
    within = Window.partitionBy(*by, "_slice").orderBy(value)
    below = F.sum("neg").over(within) - F.col("neg")
    ranked = with_slice(hist, value, cut_levels(hist, cell_rows)).withColumn("_wins", F.col("pos") * (below + F.col("neg") / 2))
    cells = ranked.groupBy(*by, "_slice").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "_wins", *carry)], F.count("*").alias("n_values")
    )
    across = Window.partitionBy(*by).orderBy("_slice")
    placed = cells.withColumn("_neg_below", F.sum("neg").over(across) - F.col("neg"))
    won = F.sum(F.col("_wins") + F.col("pos") * F.col("_neg_below").cast("double"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.groupBy(*by).agg(
        F.try_divide(won, pairs).alias("auc"),
        F.try_divide(won * 2 - pairs, pairs).alias("gini"),
        *[F.sum(c).alias(c) for c in ("pos", "neg", "n_values", *carry)],
    )


def grouped_quantiles(
    hist: DataFrame, by: Sequence[str], value: str, weight: str, probs: Sequence[float], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Exact interpolated quantiles: one row (group, prob, quantile).

    Cell totals tell which value range holds each wanted order statistic. Ranges that may hold more
    than ``cell_rows`` rows are cut again by themselves, and only rows of the last ranges are put in
    order. Ranges are passed on as values, not slice numbers, so the passes need not agree on the
    cuts. ``by`` must name a bounded set (features, splits, one month): the ranges, two per group
    and probability, are broadcast.
    """
    rows = hist.select(*by, value, F.col(weight).alias("_w"))
    cell = [F.sum("_w").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")]
    cells = with_slice(rows, value).groupBy(*by, "_slice").agg(*cell)
    # At most SLICES rows per group, or per range, in these windows.
    group = Window.partitionBy(*by)
    placed = cells.select(
        "*",
        (F.sum("_n").over(group.orderBy("_slice")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
    )
    holds_rank = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    wanted = (
        placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_position", F.col("prob") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_position"), F.ceil("_position")))))
        .filter(holds_rank)
        .select(*by, "prob", "_position", "_rank", "_before", "_low", "_high")
    )
    axis, one_range = F.col(value).cast("double"), [*by, "prob", "_rank"]

    def inside(ranges: DataFrame) -> DataFrame:
        within = F.col(value).between(F.col("_low"), F.col("_high"))
        return rows.join(F.broadcast(ranges), on=list(by)).filter(within)

    for _ in range(1, cut_levels(hist, cell_rows)):
        cuts = inside(wanted).groupBy(*one_range).agg(_cuts(axis).alias("_cuts"))
        finer = (
            inside(wanted)
            .withColumnRenamed("_before", "_start")
            .drop("_low", "_high")
            .join(F.broadcast(cuts), one_range)
            .withColumn("_slice", _slice_number(axis, F.col("_cuts")))
            .groupBy(*one_range, "_position", "_start", "_slice")
            .agg(*cell)
        )
        upto = F.sum("_n").over(Window.partitionBy(*one_range).orderBy("_slice"))
        wanted = (
            finer.withColumn("_before", F.col("_start") + upto - F.col("_n"))
            .filter(holds_rank)
            .select(*by, "prob", "_position", "_rank", "_before", "_low", "_high")
        )
    order = Window.partitionBy(*one_range).orderBy(value)
    upto = F.col("_before") + F.sum("_w").over(order)
    hit = inside(wanted).withColumn("_upto", upto).filter(
        (F.col("_upto") - F.col("_w") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    )
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    step = F.max(F.col("_position") - F.floor("_position"))
    return hit.groupBy(*by, "prob").agg((low + (high - low) * step).alias("quantile"))


def bracketed(df: DataFrame, columns: Sequence[str], prob: float, margin: float = 0.01) -> DataFrame:
    """Clamp each column to a narrow range around its quantile, which that leaves unchanged.

    A histogram of the result holds a few percent of the distinct values, so far less is shuffled.
    The range comes from a sketch whose rank error is a tenth of the margin; a counting pass then
    proves that the wanted order statistics lie inside, and a column where they do not stays whole.
    ``df`` is read twice here: store it first. Two numbers per column reach the driver.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    shares = [max(prob - margin, 0.0), min(prob + margin, 1.0)]
    sketch = df.agg(*[F.percentile_approx(v, shares, int(10 / margin)).alias(c) for c, v in values.items()]).first()
    ranges = {c: sketch[c] for c in columns if sketch[c] is not None}
    if not ranges:
        return df

    def proof(c: str) -> Column:
        low, high = ranges[c]
        below = F.sum((values[c] < low).cast("long"))
        upto = F.sum((values[c] <= high).cast("long"))
        position = prob * (F.count(values[c]) - 1)
        return ((below <= F.floor(position)) & (F.ceil(position) < upto)).alias(c)

    proven = df.agg(*[proof(c) for c in ranges]).first()
    clamped = {c: F.least(F.greatest(values[c], F.lit(lo)), F.lit(hi)) for c, (lo, hi) in ranges.items() if proven[c]}
    # greatest and least skip nulls, so a missing value has to be kept missing.
    return df.withColumns({c: F.when(values[c].isNotNull(), v) for c, v in clamped.items()})
