"""Gold: the forward-looking label, anchored at the application month, with that month's features."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.functions import columns as C
from lendscape.operators.keys import first_per_key, total_order
from lendscape.plans.silver import KEY

LOAN = ["Customer_ID", "loan_id"]
MONTHS_ON_BOOK = 6
DAYS_PAST_DUE = 30


def application_rows(loans: DataFrame) -> DataFrame:
    """Month-0 rows: where a loan's features are anchored."""
    return loans.filter("installment_num = 0").select("Customer_ID", "loan_id", "snapshot_date")


def _sightings(loans: DataFrame, mob: int) -> DataFrame:
    """What each row of the first ``mob`` months says of its loan: days past due, month on book, whether it is month 0."""
    month = F.col("mob")
    counted = loans.filter(month.between(0, mob) & F.col("Customer_ID").isNotNull() & F.col("loan_id").isNotNull())
    return counted.select(
        *LOAN,
        "snapshot_date",
        F.when(month >= 1, F.col("dpd")).alias("max_dpd"),
        F.when(month >= 1, month).alias("max_mob"),
        (month == 0).alias("anchored"),
    )


def loan_months(loans: DataFrame, mob: int = MONTHS_ON_BOOK) -> DataFrame:
    """The state a label is merged from: one narrow row for each loan and month in which it was reported.

    Months can be replaced one by one, and rows of any number of months merge into the same label (``merged_labels``).
    """
    return _sightings(loans, mob).groupBy(*LOAN, "snapshot_date").agg(
        F.max("max_dpd").alias("max_dpd"), F.max("max_mob").alias("max_mob"), F.max("anchored").alias("anchored")
    )


def merged_labels(state: DataFrame, mob: int = MONTHS_ON_BOOK, dpd: int = DAYS_PAST_DUE) -> DataFrame:
    """Labels from the state, or from single rows of the same form."""
    per_loan = state.groupBy("Customer_ID", "loan_id").agg(
        F.max("max_dpd").alias("max_dpd"),
        F.max("max_mob").alias("max_mob"),
        F.min(F.when(F.col("anchored"), F.col("snapshot_date"))).alias("snapshot_date"),
    )
    mature = per_loan.filter((F.col("max_mob") >= mob) & F.col("snapshot_date").isNotNull())
    return mature.select(
        "loan_id",
        "Customer_ID",
        F.when(F.col("max_dpd") >= dpd, 1).otherwise(0).alias("label"),
        F.lit(f"{dpd}dpd_within_{mob}mob").alias("label_def"),
        "snapshot_date",
        "max_dpd",
    )


def labels(loans: DataFrame, mob: int = MONTHS_ON_BOOK, dpd: int = DAYS_PAST_DUE) -> DataFrame:
    """1 where a loan got ``dpd`` days past due in its first ``mob`` months.

    A loan counts once month ``mob`` has been seen, whether or not every month before it was, and
    only if it has a month-0 row (the earliest, should there be several). Label and anchor come
    out of the same aggregation, so the loans are read and shuffled once.
    """
    return merged_labels(_sightings(loans, mob), mob, dpd)


def months_touched(state: DataFrame, changed: DataFrame | None, mob: int = MONTHS_ON_BOOK) -> DataFrame:
    """Application months whose labels may differ, as ``changed`` rows of the state came, went or are about to be replaced.

    None stands for all rows: then no loan has to be looked up. ``state`` holds the rows from before and after. Of it only month-0 rows and those that complete a loan are read; a loan that was
    complete neither before nor after has no label and touches nothing.
    """
    telling = state.filter(F.col("anchored") | (F.col("max_mob") >= mob))
    of_changed = telling if changed is None else telling.join(changed.select(*LOAN).distinct(), LOAN, "left_semi")
    per_loan = of_changed.groupBy(*LOAN).agg(
        F.max("max_mob").alias("max_mob"),
        F.collect_set(F.when(F.col("anchored"), F.col("snapshot_date"))).alias("applied"),
    )
    return per_loan.filter(F.col("max_mob") >= mob).select(F.explode("applied").alias("snapshot_date")).distinct()


def labels_of_months(
    state: DataFrame, months: Sequence[date], mob: int = MONTHS_ON_BOOK, dpd: int = DAYS_PAST_DUE, most: bool = False
) -> DataFrame:
    """Labels of the loans that applied in some months. Only loans with a month-0 row there are merged.

    With ``most`` of the state's months asked for all loans are merged: looking up nearly all of them would only cost.
    """
    inside = F.col("snapshot_date").isin(list(months))
    if most:
        return merged_labels(state, mob, dpd).filter(inside)
    applied = state.filter(F.col("anchored") & inside).select(*LOAN).distinct()
    return merged_labels(state.join(applied, LOAN, "left_semi"), mob, dpd).filter(inside)


def financial_features(financials: DataFrame) -> DataFrame:
    debt = C.guarded_ratio(F.col("Outstanding_Debt"), F.col("Annual_Income"))
    emi = C.guarded_ratio(F.col("Total_EMI_per_month"), F.col("Monthly_Inhand_Salary"))
    saved = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("Monthly_Balance", "Amount_invested_monthly")]
    months = C.history_months(F.col("Credit_History_Age"))
    years = C.whole_years(months)
    behaviour = F.col("Payment_Behaviour")
    return financials.select(
        "*",
        debt.alias("Debt_to_Income_Ratio"),
        emi.alias("EMI_to_Salary_Ratio"),
        C.guarded_ratio(saved[0] + saved[1], F.col("Monthly_Inhand_Salary")).alias("Savings_Propensity"),
        C.first_match(behaviour, S.SPEND_RISK, S.PAYMENT_RISK_DEFAULT).alias("Spend_Level_Idx"),
        C.first_match(behaviour, S.PAYMENT_VALUE_RISK, S.PAYMENT_RISK_DEFAULT).alias("Payment_Value_Level_Idx"),
        months.alias("Credit_History_Age_Months"),
        years.alias("Credit_History_Age_Years"),
        F.when(years > 15, 1).otherwise(0).alias("is_Credit_Age_gt_15"),
    )


def demographic_features(attributes: DataFrame) -> DataFrame:
    return attributes.select(
        "*",
        F.when(F.col("Age") >= 45, 1).otherwise(0).alias("Is_Age_gt_45"),
        C.occupation_risk().alias("Occupation_Idx"),
    )


def feature_store(
    loans: DataFrame,
    clickstream: DataFrame,
    attributes: DataFrame,
    financials: DataFrame,
    mob: int = MONTHS_ON_BOOK,
    dpd: int = DAYS_PAST_DUE,
) -> DataFrame:
    """Labels with the features of the same customer in the application month, in published order."""
    return with_features(labels(loans, mob, dpd), clickstream, attributes, financials)


def with_features(wide: DataFrame, clickstream: DataFrame, attributes: DataFrame, financials: DataFrame) -> DataFrame:
    """Labels with the features of the same customer and month, in published order.

    The three left joins share one key, so labels are exchanged for it once. The feature tables
    hold one row per key; a hot key can only come from the labels, and adaptive execution splits
    it (see ``session.RUNTIME_SETTINGS``). Columns no one publishes are pruned at the scans.
    """
    for features in (financial_features(financials), clickstream, demographic_features(attributes)):
        wanted = [c for c in features.columns if c in KEY or c in S.STORE_COLUMNS]
        wide = wide.join(features.select(*wanted), on=KEY, how="left")
    return wide.select(*S.STORE_COLUMNS)


def one_row_per_loan(store: DataFrame) -> DataFrame:
    """De-duplicate stores that repeat loans (one cumulative table per month, for instance)."""
    return first_per_key(store, ["loan_id"], total_order(store))
