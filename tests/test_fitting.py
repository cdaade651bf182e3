"""What preprocessing is fitted on, and what cleaning costs a value."""

import re
from datetime import date

from pyspark.sql import functions as F

from contract.queries import Inputs
from lendscape import schemas as S
from lendscape.functions import columns as C
from lendscape.plans import training


def test_fitting_builds_and_stores_the_windows_only(spark):
    """Months that are neither fitted nor held out are not stored, and the feature store is left as it was."""
    text = {"loan_id", "Customer_ID", "label_def", "Occupation", "Payment_Behaviour"}
    columns = [
        F.col("id").cast("string" if c in text else "double").alias(c) for c in S.STORE_COLUMNS if c not in ("label", "snapshot_date")
    ]
    month = F.add_months(F.lit(date(2001, 1, 1)), -(F.col("id") % 60).cast("int")).alias("snapshot_date")
    inputs = Inputs.__new__(Inputs)
    inputs.spark = spark
    inputs.store = store = spark.range(600).select(*columns, (F.col("id") % 3 == 0).cast("int").alias("label"), month)
    wanted = sorted(map(tuple, training.with_split(store, inputs.windows).select("loan_id", "split").collect()))
    rows, _ = inputs.fitted
    assert inputs.store is store
    assert all("/tagged-" in f for f in inputs.tagged.inputFiles()) and inputs.tagged.inputFiles()
    assert sorted(map(tuple, inputs.tagged.select("loan_id", "split").collect())) == wanted and 0 < len(wanted) < 600
    assert rows.count() == sum(split == "train" for _, split in wanted)


def test_clean_numbers_meet_no_regex(spark):
    texts = ["12.50", "-3", "28_", "__10000__", "1e5", " 7", "", "٣", None, "a-b.c"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.keep_only(F.col("t"), "0-9.-").alias("kept"))
    assert {r.t: r.kept for r in found.collect()} == {t: None if t is None else re.sub("[^0-9.-]", "", t) for t in texts}
    assert "ltrim" in found._jdf.queryExecution().optimizedPlan().toString()
