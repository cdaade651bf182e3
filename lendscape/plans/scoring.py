"""Batch scoring of the feature store, and the two tables that follow from it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.operators import drift
from lendscape.plans.gold import one_row_per_loan
from lendscape.plans.training import Trained
from lendscape.session import scratch
from lendscape.sources import layers

THRESHOLD = 0.5


def predictions(store: DataFrame, trained: Trained, month: date | None = None) -> DataFrame:
    """Probability and class of every loan, or of one application month's; a repeated loan is scored once."""
    if month is not None:
        store = store.filter(F.col("snapshot_date") == F.lit(month))
    if store.isEmpty():
        raise ValueError(f"nothing to score{'' if month is None else f' in {month}'}")
    store = one_row_per_loan(store)
    return with_class(trained.score(store), trained.version)


def with_class(scored: DataFrame, version: str) -> DataFrame:
    return scored.select(
        "loan_id", "Customer_ID", "snapshot_date", "label",
        F.lit(version).alias("model_version"),
        "model_predict_proba",
        (F.col("model_predict_proba") >= THRESHOLD).cast("int").alias("model_predict_label"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """Predicted against actual bad rate."""
    return scored.agg(
        F.count("*").alias("n"),
        F.round(F.avg("model_predict_label"), 3).alias("predicted_bad_rate"),
        F.round(F.avg("label"), 3).alias("actual_bad_rate"),
    )


def write_predictions(scored: DataFrame, root: str) -> None:
    layers.write_table(scored, layers.path_of(root, "gold", "model_predictions"))


def write_monitoring(spark: SparkSession, root: str) -> DataFrame:
    """Monthly metrics of all stored predictions, as Parquet and as CSV.

    One row per month; the CSV is copied from the Parquet just written.
    """
    stored = layers.read_table(spark, root, "gold", "model_predictions")
    path = layers.path_of(root, "gold", "model_monitoring")
    with scratch(spark):
        drift.monthly_metrics(stored).write.mode("overwrite").parquet(f"{path}/parquet")
    written = spark.read.parquet(f"{path}/parquet").orderBy("month")
    written.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return written
