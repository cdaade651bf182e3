"""Month arithmetic: the calendar of a backfill and the windows of a training run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shift_months(day: date, months: int) -> date:
    """Same day in another month, for days every month has."""
    if day.day > 28:
        raise ValueError(f"{day} has no counterpart in every month")
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, day.day)


def month_starts(start: date, end: date) -> list[date]:
    """First day of every month from ``start``'s month up to ``end``."""
    first = start.replace(day=1)
    span = (end.year - first.year) * 12 + end.month - first.month
    return [shift_months(first, k) for k in range(span + 1)]


def month_calendar(spark: SparkSession, start: Column, end: Column, source: DataFrame | None = None) -> DataFrame:
    """The same calendar as rows; with a ``source``, ``start`` and ``end`` aggregate over it."""
    bounds = (source if source is not None else spark.range(1)).agg(
        F.trunc(start, "MM").alias("start"), end.cast("date").alias("end")
    )
    step = F.expr("interval 1 month")
    return bounds.select(F.explode(F.sequence("start", "end", step)).alias("month"))


@dataclass(frozen=True)
class Windows:
    """Periods of one training run, inclusive at both ends, counted back from its snapshot."""

    snapshot: date
    fit_start: date
    fit_end: date
    oot_start: date
    oot_end: date

    def segment(self, day: Column) -> Column:
        """Which period an application month falls in."""
        return (
            F.when(day.between(F.lit(self.oot_start), F.lit(self.oot_end)), "OOT")
            .when(day.between(F.lit(self.fit_start), F.lit(self.fit_end)), "Train/Dev")
            .otherwise("unused")
        )

    @property
    def version(self) -> str:
        return f"credit_model_{self.snapshot:%Y_%m_%d}"


def training_windows(snapshot: date, fit_months: int = 12, oot_months: int = 2) -> Windows:
    oot_start = shift_months(snapshot, -oot_months)
    day = timedelta(days=1)
    return Windows(snapshot, shift_months(oot_start, -fit_months), oot_start - day, oot_start, snapshot - day)
