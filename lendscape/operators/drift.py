"""Monthly model monitoring: accuracy where labels have matured, and stability of the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscape.operators.ranks import grouped_auc, grouped_quantiles, histogram

BINS = 10
FLOOR = 1e-6
MIN_BASELINE_ROWS = 50
# Lower bound of each drift class.
MAJOR, MODERATE = 0.25, 0.10


def score_histogram(predictions: DataFrame) -> DataFrame:
    """One row per (month, score); all monthly metrics derive from it."""
    rows = predictions.select(
        F.trunc("snapshot_date", "MM").alias("month"),
        F.col("model_predict_proba").alias("score"),
        "label",
    )
    return histogram(rows, ["month"], "score", n=F.lit(1), pos=F.col("label"), neg=1 - F.col("label"))


def baseline_month(hist: DataFrame, min_rows: int = MIN_BASELINE_ROWS) -> DataFrame:
    """The earliest month with enough rows, or else the earliest."""
    volumes = hist.groupBy("month").agg(F.sum("n").alias("n"))
    enough = F.min(F.when(F.col("n") >= min_rows, F.col("month")))
    return volumes.agg(F.coalesce(enough, F.min("month")).alias("baseline"))


def inner_edges(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """Distinct quantile edges of the baseline month without the two outer ones, as one array.

    Rounded to 9 places: interpolated edges differ in the last bit between engines, which would
    move scores that tie with an edge.
    """
    base = hist.withColumn("_baseline", baseline_month(hist).scalar()).filter("month = _baseline")
    edges = grouped_quantiles(base.drop("_baseline"), ["month"], "score", "n", [k / bins for k in range(bins + 1)])
    ordered = F.array_sort(F.collect_set(F.round("quantile", 9)))
    return edges.agg(F.slice(ordered, 2, F.greatest(F.size(ordered) - 2, F.lit(0))).alias("edges"))


def psi(expected: Column, actual: Column) -> Column:
    """Population stability index of two arrays of bin counts, shares floored at ``FLOOR``."""

    def shares(counts: Column) -> Column:
        total = F.greatest(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
        return F.transform(counts, lambda x: F.greatest(x / total, F.lit(FLOOR)))

    terms = F.zip_with(shares(actual), shares(expected), lambda a, e: (a - e) * F.ln(a / e))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def monthly_metrics(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """Volume, actual and predicted rate, AUC, Gini and PSI of every month.

    The histogram carries each row's bin counts through the AUC cells, so nothing is joined per
    month. A bin the merged edges leave unused is empty on both sides and adds nothing to the PSI.
    """
    hist = score_histogram(predictions)
    binned = hist.withColumn("_edges", inner_edges(hist, bins).scalar()).withColumn(
        "_bin", F.size(F.filter("_edges", lambda e: e <= F.col("score")))
    )
    names = [f"_bin{k}" for k in range(bins)]
    prepared = binned.select(
        "month", "score", "n", "pos", "neg",
        (F.col("score") * F.col("n")).alias("_score_sum"),
        *[F.when(F.col("_bin") == k, F.col("n")).otherwise(0).alias(c) for k, c in enumerate(names)],
    )
    months = grouped_auc(prepared, ["month"], "score", carry=["n", "_score_sum", *names])
    # One row per month from here on: bounded by the calendar.
    calendar = Window.partitionBy(F.lit(0))
    base = F.coalesce(
        F.min(F.when(F.col("n") >= MIN_BASELINE_ROWS, F.col("month"))).over(calendar), F.min("month").over(calendar)
    )
    counts = F.array(*names)
    expected = F.max_by(counts, F.col("month") == F.col("_base")).over(calendar)
    return (
        months.withColumn("_base", base)
        .withColumn("_expected", expected)
        .select(
            "month",
            F.col("n").alias("n_records"),
            F.round(F.col("pos") / F.col("n"), 4).alias("actual_bad_rate"),
            F.round(F.col("_score_sum") / F.col("n"), 4).alias("avg_predicted_proba"),
            F.round("auc", 4).alias("auc"),
            F.round("gini", 4).alias("gini"),
            F.round(psi(F.col("_expected"), counts), 4).alias("psi_vs_baseline"),
        )
    )


def drift_class(value: Column) -> Column:
    return (
        F.when(value >= MAJOR, "MAJOR DRIFT -> recommend model refresh")
        .when(value >= MODERATE, "MODERATE DRIFT -> monitor closely")
        .otherwise("STABLE -> no action needed")
    )


def drift_verdict(monitoring: DataFrame) -> DataFrame:
    """The latest month with a PSI and what it says."""
    usable = monitoring.filter("psi_vs_baseline is not null")
    latest = usable.agg(F.max("month").alias("month"), F.max_by("psi_vs_baseline", "month").alias("psi"))
    return latest.select("month", "psi", drift_class(F.col("psi")).alias("verdict")).filter("month is not null")
