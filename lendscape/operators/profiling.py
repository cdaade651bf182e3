"""Column profiles. Each is one job over all columns at once, never one job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscape.operators.ranks import grouped_quantiles, histogram, value_counts


def _long(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    return df.select(*[F.col(c).try_cast(dtype).alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")


def value_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each non-null value occurs."""
    counts = value_counts(_long(df, columns, "string"), ["feature"], "value")
    return counts.orderBy("feature", F.desc("n"), "value")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negatives and range of all values; mean, median and mode (lowest of ties) of those >= 0.

    All of it derives from one histogram per column.
    """
    hist = histogram(_long(df, columns, "double"), ["feature"], "value", n=F.lit(1))
    valid = F.col("value") >= 0
    stats = hist.groupBy("feature").agg(
        F.sum(F.when(~valid, F.col("n")).otherwise(0)).alias("negative_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.round(
            F.try_divide(F.sum(F.when(valid, F.col("value") * F.col("n"))), F.sum(F.when(valid, F.col("n")))), 6
        ).alias("mean"),
        F.max_by("value", F.when(valid, F.struct("n", -F.col("value")))).alias("mode"),
    )
    medians = grouped_quantiles(hist.filter(valid), ["feature"], "value", "n", [0.5])
    # One row per profiled column on either side.
    medians = F.broadcast(medians.select("feature", F.round("quantile", 6).alias("median")))
    return stats.join(medians, on="feature", how="left")


def negative_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each negative value's count and its share of all rows of the table."""
    total = df.agg(F.count("*")).scalar()
    negatives = value_counts(_long(df, columns, "double").filter("value < 0"), ["feature"], "value")
    return negatives.select(
        "feature",
        F.col("value").alias("negative_value"),
        F.col("n").alias("count"),
        F.round(F.try_divide(F.col("n") * 100, total), 2).alias("percentage_overall"),
    ).orderBy("feature", F.desc("count"), "negative_value")


def age_text_profile(df: DataFrame, low: int = 10, high: int = 100) -> DataFrame:
    """Ages that are not plain digits, and the range of those that are numbers, whole and clipped."""
    text = F.coalesce(F.col("Age"), F.lit("None"))
    number = F.col("Age").try_cast("double")
    plausible = F.when(number.between(low, high), number)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.when(text.rlike("^[0-9]+$"), 0).otherwise(1)).alias("malformed_count"),
        F.min(number).alias("min_age"),
        F.max(number).alias("max_age"),
        F.min(plausible).alias("min_plausible_age"),
        F.max(plausible).alias("max_plausible_age"),
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of their key; a missing key counts as a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def coverage(df: DataFrame, columns: Sequence[str], places: int = 1) -> DataFrame:
    """Percentage of rows with a value, per column, in one pass."""
    shares = df.agg(*[F.round(F.try_divide(F.count(c) * 100, F.count("*")), places).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "feature", "non_null_percent")


def store_counts(store: DataFrame) -> DataFrame:
    """Rows, distinct loans, customers and months of a table with one row per loan and month."""
    return store.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("loan_id").alias("n_loans"),
        F.countDistinct("Customer_ID").alias("n_customers"),
        F.countDistinct("snapshot_date").alias("n_months"),
    )


def max_loans_per_customer(store: DataFrame) -> DataFrame:
    pairs = store.select("Customer_ID", "loan_id").filter("Customer_ID is not null").distinct()
    return pairs.groupBy("Customer_ID").count().agg(F.max("count").alias("max_loans_per_customer"))


def preview(df: DataFrame, order: Sequence[str], rows: int = 50) -> DataFrame:
    """A table's first rows in a stated order, for display."""
    return df.orderBy(*order).limit(rows)
