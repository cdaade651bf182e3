"""Hot keys, plan shapes and lost order: what has to hold when the data is large and uneven."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.operators import keys, rates
from lendscape.plans import gold, silver
from lendscape.session import stored


def executed(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture
def small_skew_thresholds(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        # Small inputs coalesce to one task otherwise, and skew is split by map task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_key():
    return F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5000))


def test_equal_rows_shrink_before_the_customer_join(spark):
    rows = spark.range(3000).select(hot_key().alias("Customer_ID"), (F.col("id") % 7).alias("v"))
    flags = spark.createDataFrame([("hot", 1), ("c1", 0), ("absent", 1)], "Customer_ID string, isDefault int")
    got = rates.with_default_flag(rows, flags)
    plain = rows.join(flags, "Customer_ID").groupBy("Customer_ID", "v", "isDefault").count()
    assert sorted(map(tuple, got.select("Customer_ID", "v", "isDefault", rates.ROWS).collect())) == sorted(map(tuple, plain.collect()))
    plan = executed(got)
    assert "partial_count" in plan.split("Join")[-1] and "explode" not in plan


def test_duplicates_shrink_before_the_shuffle(spark):
    rows = spark.range(10000).select(hot_key().alias("k"), "id")
    plan = executed(keys.first_per_key(rows, ["k"], [F.col("id")]))
    assert plan.count("WindowGroupLimit") == 2


def test_feature_joins_split_a_hot_customer(spark, small_skew_thresholds):
    """A third of all loans belong to one customer and month: every join of the chain splits it."""
    base = spark.range(60_000).select(F.col("id").cast("string").alias("loan_id"), hot_key().alias("Customer_ID"))
    book = base.crossJoin(spark.createDataFrame([(0,), (6,)], "mob int")).select(
        "loan_id", "Customer_ID", "mob", F.col("mob").alias("installment_num"), F.lit(0).alias("dpd"),
        F.add_months(F.lit(date(2023, 1, 1)), "mob").alias("snapshot_date"),
    )
    book = stored(book, "book")
    month = F.lit(date(2023, 1, 1)).alias("snapshot_date")
    who = base.select("Customer_ID").distinct()
    tables = []
    for table in ("clickstream", "attributes", "financials"):
        known = {c: t for c, t in S.TABLES[table].items() if c not in silver.KEY}
        filled = [F.lit(None).cast(t).alias(c) if c == "Type_of_Loan" else F.lit("1").cast(t).alias(c) for c, t in known.items()]
        tables.append(stored(who.select("Customer_ID", month, *filled), table))
    store = gold.feature_store(book, *tables)
    plan = executed(store)
    assert plan.count("skew=true") == 3
    assert store.count() == 60_000
    assert store.filter("Customer_ID = 'hot' and fe_1 = 1 and Age = 1 and Annual_Income = 1").count() == 20_000


def test_modes_do_not_gather_a_month(spark):
    rows = spark.range(1000).selectExpr("cast(id as string) Customer_ID", "cast(id % 90 as int) Age", "date_add(date'2023-01-01', cast(id % 2 as int)) snapshot_date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the planner took the lookup for a large one
    try:
        joined = keys.with_period_modes(rows, "snapshot_date", {"Age": (18, 100)})
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert joined.filter("_mode_Age = 18 + day(snapshot_date) - 1").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_read_and_shuffle_loans_once(spark):
    book = stored(spark.range(100).selectExpr(
        "cast(id % 10 as string) loan_id", "'c' Customer_ID", "cast(id % 7 as int) mob", "0 dpd", "date'2023-01-01' snapshot_date"
    ), "book")
    plan = executed(gold.labels(book))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "partial_max" in plan and "PushedFilters: [IsNotNull(mob)" in plan


def test_all_correlations_come_from_one_pass(spark):
    features = [(F.col("id") * k % 7).alias(f"f{k}") for k in range(1, 5)]
    df = stored(spark.range(500).select(*features, (F.col("id") % 2).cast("int").alias("isDefault")), "corr")
    plan = executed(rates.rank_by_correlation(df, [f"f{k}" for k in range(1, 5)]))
    assert plan.count("FileScan") == 1


def test_no_python_in_any_plan():
    """Everything runs on built-in expressions: no UDF of any kind, but for the optional part that needs them."""
    import pathlib

    import lendscape

    own = [p for p in pathlib.Path(lendscape.__file__).parent.rglob("*.py") if p.parent.name != "llm"]
    source = "".join(p.read_text() for p in own)
    for word in ("pandas_udf", "F.udf", "applyInPandas", "mapInPandas", ".rdd", "toPandas", "localCheckpoint"):
        assert word not in source, word
