"""Model bank: a folder per save below its version's, and a manifest with a row per save."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, date, datetime

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.functions.dates import training_windows
from lendscape.operators.encoding import Fitted
from lendscape.plans.training import Trained

MANIFEST = (
    "model_version string, trained_at timestamp, path string, snapshot date, features array<string>, "
    "params string, pos_weight double, overall_bad_rate double, trials string"
)
STATISTICS = "feature string, median double, mean double, std double"


def save(spark: SparkSession, trained: Trained, bank: str, results: DataFrame | None = None) -> str:
    """Store a version. Every save has a folder of its own and is published by its manifest row, last.

    An interrupted save leaves earlier ones whole, and a loaded model can be saved back to its own bank.
    """
    root = bank.rstrip("/")
    path = f"{root}/{trained.version}/{uuid.uuid4().hex}"
    fitted = trained.preprocessing
    trained.model.write().save(f"{path}/model")
    # One row per model input.
    rows = [(f, fitted.medians.get(f), *fitted.scales[f]) for f in S.FEATURES]
    spark.createDataFrame(rows, STATISTICS).coalesce(1).write.parquet(f"{path}/statistics")
    fitted.encoding.write.parquet(f"{path}/encoding")
    if results is not None:
        results.write.parquet(f"{path}/results")
    row = (
        trained.version, datetime.now(UTC), path, trained.windows.snapshot, S.FEATURES, json.dumps(trained.params),
        float(trained.pos_weight), float(fitted.overall), json.dumps(trained.trials),
    )
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return path


def manifests(spark: SparkSession, bank: str) -> DataFrame:
    """All saves in the bank, of all versions."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{bank.rstrip('/')}/manifest")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no models in {bank}: train one first") from missing


def find(spark: SparkSession, bank: str, version: str | None = None):
    """The named version's manifest row, or that of the version trained last."""
    known = manifests(spark, bank)
    if version is not None:
        known = known.filter(F.col("model_version") == version)
    row = known.agg(F.max_by(F.struct("*"), F.col("trained_at")).alias("m")).first().m
    if row is None:
        raise FileNotFoundError(f"no model {version} in {bank}")
    return row


def load(spark: SparkSession, bank: str, version: str | None = None) -> Trained:
    row = find(spark, bank, version)
    statistics = spark.read.parquet(f"{row.path}/statistics").collect()
    fitted = Fitted(
        medians={r.feature: r.median for r in statistics if r.median is not None},
        scales={r.feature: (r["mean"], r["std"]) for r in statistics},
        overall=row.overall_bad_rate,
        encoding=spark.read.parquet(f"{row.path}/encoding"),
    )
    snapshot: date = row.snapshot
    return Trained(
        model=GBTClassificationModel.load(f"{row.path}/model"),
        preprocessing=fitted,
        windows=training_windows(snapshot),
        params=json.loads(row.params),
        pos_weight=row.pos_weight,
        trials=json.loads(row.trials),
    )
