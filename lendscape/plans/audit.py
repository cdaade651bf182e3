"""Leakage audit: is each loan one row, are the splits disjoint, does any feature know the answer?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.operators import profiling
from lendscape.operators.ranks import grouped_auc, histogram
from lendscape.plans.gold import one_row_per_loan

# Above the first a feature is suspect, above the second it leaks.
SUSPECT_AUC, LEAK_AUC = 0.85, 0.95
MIN_ROWS, MIN_VALUES = 50, 2
PAIRS = [("train", "dev"), ("train", "oot"), ("dev", "oot")]


def customer_overlap(tagged: DataFrame) -> DataFrame:
    """Customers shared by each pair of splits.

    Each customer shrinks to three flags, so all pairs come from one exchange instead of three joins.
    """
    names = sorted({s for pair in PAIRS for s in pair})
    known = tagged.filter("Customer_ID is not null")
    flags = known.groupBy("Customer_ID").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in names])
    both = flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in PAIRS])
    return both.unpivot([], [f"{a}_{b}" for a, b in PAIRS], "pair", "shared_customers")


def univariate_auc(matrix: DataFrame, features: Sequence[str] = S.FEATURES) -> DataFrame:
    """How well each feature alone ranks the label, in either direction; too thin features drop out."""
    long = matrix.select("label", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        "label", list(features), "feature", "value"
    )
    hist = histogram(long, ["feature"], "value", pos=F.col("label"), neg=1 - F.col("label"))
    auc = grouped_auc(hist, ["feature"], "value")
    enough = (F.col("pos") + F.col("neg") >= MIN_ROWS) & (F.col("n_values") >= MIN_VALUES)
    best = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return auc.filter(enough & F.col("auc").isNotNull()).select("feature", F.round(best, 6).alias("univariate_auc"))


def leakage_audit(store: DataFrame, tagged: DataFrame, train_matrix: DataFrame, clickstream: DataFrame) -> DataFrame:
    """One row per check: what was found, what is allowed, and whether it passes.

    Repeated loans are counted in the store as it is; what follows looks at one row per loan.

    The inputs are the store, its rows tagged by split, the training split's feature matrix with
    its label, and the silver clickstream.
    """

    def check(name: str, df: DataFrame, value: str, allowed: float, at_most: bool = True) -> DataFrame:
        found = F.col(value).cast("double")
        passed = found <= allowed if at_most else found >= allowed
        return df.select(
            F.lit(name).alias("check_name") if name else F.col("check_name"),
            found.alias("value"), F.lit(float(allowed)).alias("allowed"), passed.cast("int").alias("passed"),
        )

    raw, store = store, one_row_per_loan(store)
    overlaps = customer_overlap(tagged).withColumn("check_name", F.concat(F.lit("customer_overlap_"), "pair"))
    anchors = profiling.coverage(store, S.ANCHOR_FEATURES).withColumn(
        "check_name", F.concat(F.lit("anchor_coverage_"), "feature")
    )
    strongest = univariate_auc(train_matrix).agg(F.max("univariate_auc").alias("auc"))
    parts = [
        check("repeated_loans", profiling.duplicate_keys(raw, "loan_id"), "duplicates", 0),
        check("repeated_click_keys", profiling.duplicate_keys(clickstream, "Customer_ID", "snapshot_date"), "duplicates", 0),
        check("max_loans_per_customer", profiling.max_loans_per_customer(store), "max_loans_per_customer", 1),
        check("", overlaps, "shared_customers", 0),
        check("", anchors, "non_null_percent", 100, at_most=False),
        check("suspect_univariate_auc", strongest, "auc", SUSPECT_AUC),
        check("leaking_univariate_auc", strongest, "auc", LEAK_AUC),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
