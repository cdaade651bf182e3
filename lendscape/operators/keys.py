"""One row per key, and per-period modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order.

    Written as ``row_number() = 1`` because Spark then keeps one candidate per key and input
    partition before the shuffle, so a heavily duplicated key does not reach one task whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def total_order(df: DataFrame) -> list[Column]:
    """Every column ascending: rows that still tie are equal, so any of them will do."""
    return [F.col(c).asc_nulls_first() for c in df.columns]


def period_modes(df: DataFrame, period: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Most frequent in-range value of each column per period, the lowest of tied values.

    Counts per (period, column, value) combine before the shuffle; nothing gathers a period's rows.
    """
    long = df.select(period, *[F.col(c).cast("double").alias(c) for c in ranges]).unpivot(
        period, list(ranges), "_column", "_value"
    )
    low = F.create_map(*[F.lit(x) for c, (lo, _) in ranges.items() for x in (c, float(lo))])
    high = F.create_map(*[F.lit(x) for c, (_, hi) in ranges.items() for x in (c, float(hi))])
    valid = long.filter(F.col("_value").between(low[F.col("_column")], high[F.col("_column")]))
    counts = valid.groupBy(period, "_column", "_value").agg(F.count("*").alias("_n"))
    best = F.struct("_n", -F.col("_value"))
    return counts.groupBy(period).agg(
        *[F.max_by("_value", F.when(F.col("_column") == c, best)).alias(f"_mode_{c}") for c in ranges]
    )


def with_period_modes(df: DataFrame, period: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Attach ``_mode_<column>`` of the row's period.

    The lookup has one row per calendar date, however many rows there are, so it is broadcast. Joined by exchange, all
    rows of a month would meet in one task, and what follows would stay dealt by month.
    """
    return df.join(F.broadcast(period_modes(df, period, ranges)), on=period, how="left")
