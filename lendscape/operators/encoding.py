"""Statistics fitted on training rows only, and their application to any rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.operators.ranks import bracketed, grouped_quantiles, histogram
from lendscape.session import outliving, stored

SMOOTHING = 20


def medians(rows: DataFrame, columns: Sequence[str] = S.NUMERIC_FEATURES) -> DataFrame:
    """Exact median per column over its non-null values: rows (feature, median). Store ``rows`` first."""
    narrow = bracketed(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns, 0.5)
    hist = histogram(narrow.unpivot([], list(columns), "feature", "value"), ["feature"], "value", n=F.lit(1))
    return grouped_quantiles(hist, ["feature"], "value", "n", [0.5]).select("feature", F.col("quantile").alias("median"))


def impute(rows: DataFrame, fitted: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Fill the numeric features; a column without any training value stays as it is."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(fitted.get(c))).alias(c) for c in S.NUMERIC_FEATURES]
    return rows.select(*keep, *filled)


def target_encoding(rows: DataFrame, columns: Sequence[str] = S.CATEGORIES, smoothing: int = SMOOTHING) -> DataFrame:
    """Label mean per category, pulled towards the overall mean by ``smoothing`` imaginary rows.

    ``rows`` are read twice: store them first.
    """
    overall = rows.agg(F.avg("label")).scalar()
    long = rows.select("label", *columns).unpivot("label", list(columns), "feature", "category")
    counts = long.groupBy("feature", "category").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    return counts.select(
        "feature",
        "category",
        "n",
        ((F.col("bad") + overall * smoothing) / (F.col("n") + smoothing)).alias("encoded"),
    )


def apply_encoding(
    rows: DataFrame, table: DataFrame, overall: Column, columns: Sequence[str] = S.CATEGORIES
) -> DataFrame:
    """Attach ``<column>_TE``; a category never seen in training gets the overall mean.

    The map is a stored table, so the planner knows its size and joins accordingly.
    """
    for c in columns:
        part = table.filter(F.col("feature") == c).select(F.col("category").alias(c), F.col("encoded").alias("_encoded"))
        rows = rows.join(part, on=c, how="left").withColumn(f"{c}_TE", F.coalesce("_encoded", overall)).drop("_encoded")
    return rows


def scales(rows: DataFrame, columns: Sequence[str] = S.FEATURES) -> DataFrame:
    """Mean and population deviation per column; a constant column is left unscaled."""
    stats = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    return stats.unpivot([], list(columns), "feature", "s").select(
        "feature", F.col("s.mean").alias("mean"), F.when(F.col("s.std") > 0, F.col("s.std")).otherwise(1.0).alias("std")
    )


@dataclass(frozen=True)
class Fitted:
    """What preprocessing learnt. All but the encoding map has a fixed size, one entry per feature."""

    medians: dict[str, float]
    scales: dict[str, tuple[float, float]]
    overall: float
    encoding: DataFrame

    def transform(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Impute, encode, scale; the columns come out in training order."""
        encoded = self.encoded(rows, keep)
        return encoded.select(*keep, *[self._scaled(f) for f in S.FEATURES])

    def encoded(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The features before scaling."""
        filled = impute(rows, self.medians, [*keep, *S.CATEGORIES])
        return apply_encoding(filled, self.encoding, F.lit(self.overall))

    def _scaled(self, feature: str) -> Column:
        mean, std = self.scales[feature]
        return ((F.col(feature) - F.lit(mean)) / F.lit(std)).alias(feature)


def fit(rows: DataFrame) -> Fitted:
    """Fit on training rows, which are passed over several times: store them first.

    Only per-feature numbers come back to the driver: one median, mean and deviation each.
    """
    middle = {r.feature: r.median for r in medians(rows).collect()}
    with outliving(rows.sparkSession):
        table = stored(target_encoding(rows), "encoding")
    overall = rows.agg(F.avg("label")).first()[0]
    draft = Fitted(middle, {}, overall, table)
    spread = {r.feature: (r["mean"], r["std"]) for r in scales(draft.encoded(rows, [])).collect()}
    return Fitted(middle, spread, overall, table)
