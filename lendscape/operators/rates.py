"""Default rates by category, by quantile bucket and by list element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscape.functions.columns import loan_type_name, percent
from lendscape.operators.keys import first_per_key
from lendscape.operators.ranks import grouped_quantiles, histogram


def latest_default_flag(loans: DataFrame) -> DataFrame:
    """Each customer's most recent loan row, and whether anything is overdue on it."""
    order = [F.col("snapshot_date").desc(), F.col("loan_id").asc(), F.col("overdue_amt").desc()]
    latest = first_per_key(loans.select("Customer_ID", "loan_id", "snapshot_date", "overdue_amt"), ["Customer_ID"], order)
    return latest.select(
        "Customer_ID", "overdue_amt", F.when(F.col("overdue_amt") > 0, 1).otherwise(0).alias("isDefault")
    )


ROWS = "_rows"


def with_default_flag(rows: DataFrame, flags: DataFrame, counted: bool = True) -> DataFrame:
    """Rows of customers that have a loan, with the flag. Select the needed columns first.

    Equal rows of a customer become one with their number (``_rows``) before the join, so a customer with
    most of the rows has shrunk when it is met. Not ``counted``, every row is kept; the join is one that
    adaptive execution can split.
    """
    if counted:
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias(ROWS))
    return rows.join(flags.select("Customer_ID", "isDefault"), "Customer_ID")


def _weight(flagged: DataFrame) -> Column:
    return F.col(ROWS) if ROWS in flagged.columns else F.lit(1)


def bad_rate_by(flagged: DataFrame, *keys: str, count_as: str = "Total_Customers", **means: tuple[Column, int]) -> DataFrame:
    """Rows, defaults and default rate per key; ``means`` adds rounded averages."""
    n = _weight(flagged)
    rows, bad = F.sum(n), F.sum(F.col("isDefault") * n)

    def mean(c: Column) -> Column:
        return F.try_divide(F.sum(c * n), F.sum(F.when(c.isNotNull(), n)))

    return flagged.groupBy(*keys).agg(
        rows.alias(count_as),
        bad.alias("Total_Defaults"),
        percent(bad, rows).alias("Default_Rate_Percent"),
        *[F.round(mean(c), places).alias(name) for name, (c, places) in means.items()],
    )


def quantile_buckets(hist: DataFrame, by: Sequence[str], value: str, weight: str, buckets: int) -> DataFrame:
    """Number the equal-frequency bucket of each histogram row, lower edge inclusive.

    Equal edges merge, so a feature with few values gets fewer buckets. The edges, at most
    ``buckets - 1`` per feature, are broadcast.
    """
    shares = [k / buckets for k in range(1, buckets)]
    edges = (
        grouped_quantiles(hist, by, value, weight, shares)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set(F.round("quantile", 9))).alias("_edges"))
    )
    joined = hist.join(F.broadcast(edges), on=list(by), how="left")
    number = F.size(F.filter("_edges", lambda e: e <= F.col(value)))
    return joined.withColumn("bucket", number).drop("_edges")


def bad_rate_by_bucket(flagged: DataFrame, features: Sequence[str], buckets: int = 5, places: int = 2) -> DataFrame:
    """Default rate per equal-frequency bucket of each feature, all features in one job.

    Rows are reduced to (feature, value) counts first; everything after that works on distinct
    values only.
    """
    ids = ["isDefault", ROWS]
    values = [F.col(f).cast("double").alias(f) for f in features]
    long = flagged.select("isDefault", _weight(flagged).alias(ROWS), *values).unpivot(ids, list(features), "feature", "value")
    hist = histogram(long, ["feature"], "value", n=F.col(ROWS), bad=F.col("isDefault") * F.col(ROWS))
    return (
        quantile_buckets(hist, ["feature"], "value", "n", buckets)
        .groupBy("feature", "bucket")
        .agg(
            F.sum("n").alias("Total_Customers"),
            F.sum("bad").alias("Total_Defaults"),
            percent(F.sum("bad"), F.sum("n")).alias("Default_Rate_Percent"),
            F.round(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), places).alias("Avg_Value"),
        )
    )


def listed_loan_types(financials: DataFrame, *, once_per_customer: bool) -> DataFrame:
    """One row per loan type a customer lists; repeats fold before anything is joined."""
    types = (
        financials.select("Customer_ID", F.explode("Type_of_Loan").alias("_text"))
        .select("Customer_ID", loan_type_name(F.col("_text")).alias("Single_Loan_Type"))
        .filter("Single_Loan_Type != ''")
    )
    return types.distinct() if once_per_customer else types


def rank_by_correlation(flagged: DataFrame, features: Sequence[str], target: str = "isDefault") -> DataFrame:
    """Pearson correlation of every feature with the target, strongest first; constants drop out.

    One aggregation holds the moments of all features: no row is repeated per feature.
    """
    def pair(f: str) -> Column:
        x, y = F.col(f).cast("double"), F.when(F.col(f).isNotNull(), F.col(target).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f)

    one_row = flagged.agg(*[pair(f) for f in features])
    return (
        one_row.unpivot([], list(features), "feature", "correlation")
        .filter("correlation is not null")
        .withColumn("strength", F.abs("correlation"))
    )


def top_correlations(ranking: DataFrame, k: int = 5) -> DataFrame:
    return ranking.orderBy(F.desc("strength"), "feature").limit(k)


def bad_rate_by_month_on_book(loans: DataFrame, dpd: int = 30) -> DataFrame:
    flag = F.when(F.col("dpd") >= dpd, 1).otherwise(0)
    return loans.groupBy("mob").agg(
        F.count("*").alias("n_rows"),
        F.sum(flag).alias("n_bad"),
        F.round(F.try_divide(F.sum(flag), F.count("*")), 6).alias("bad_rate"),
    )
