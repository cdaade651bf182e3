"""Labels, features and the point-in-time join."""

import random
from datetime import date

import pytest

from lendscape import schemas as S
from lendscape.functions.dates import month_starts, shift_months, training_windows
from lendscape.plans import gold, silver, training
from tests.test_silver import JAN, financials



def loans(spark, rows):
    typed = [(i, c, m, m, d, shift_months(date(2023, 1, 1), m)) for i, c, m, d in rows]
    schema = "loan_id string, Customer_ID string, mob int, installment_num int, dpd int, snapshot_date date"
    return spark.createDataFrame(typed, schema)


def test_label_looks_at_months_one_to_six(spark):
    rows = [("bad", "c", m, 31 if m == 6 else 0) for m in range(7)]
    rows += [("late", "c", m, 90 if m == 7 else 0) for m in range(8)]
    rows += [("edge", "c", m, 30 if m == 2 else 0) for m in range(7)]
    rows += [("before", "c", m, 99 if m == 0 else 0) for m in range(7)]
    got = {r.loan_id: r.label for r in gold.labels(loans(spark, rows)).collect()}
    assert got == {"bad": 1, "late": 0, "edge": 1, "before": 0}


def test_label_needs_the_last_month_and_an_application_row(spark):
    rows = [("young", "c", m, 0) for m in range(6)]
    rows += [("gaps", "c", m, None) for m in (0, 6)]
    rows += [("orphan", "c", m, 0) for m in range(1, 7)]
    got = gold.labels(loans(spark, rows)).collect()
    assert [(r.loan_id, r.label, r.label_def, r.snapshot_date) for r in got] == [
        ("gaps", 0, "30dpd_within_6mob", date(2023, 1, 1))
    ]


def test_label_does_not_depend_on_row_order(spark):
    rows = [(f"l{k}", f"c{k % 3}", m, (k * m * 7) % 50) for k in range(20) for m in range(7)]
    expected = sorted(map(str, gold.labels(loans(spark, rows)).collect()))
    random.Random(1).shuffle(rows)
    assert sorted(map(str, gold.labels(loans(spark, rows)).collect())) == expected


def test_guarded_ratios(frame):
    df = financials(
        frame, Annual_Income=["0", "100", None, "100"], Outstanding_Debt=["5", "50", "5", None],
        Monthly_Inhand_Salary=["0", "10", None, "4"], Monthly_Balance=["1", None, "1", "2"], Amount_invested_monthly=["1", "5", "1", None],
    )
    got = {r.Customer_ID: r for r in gold.financial_features(silver.clean_financials(df)).collect()}
    assert [got[k].Debt_to_Income_Ratio for k in "0123"] == [0.0, 0.5, 0.0, None]
    assert [got[k].Savings_Propensity for k in "0123"] == [0.0, 0.5, 0.0, 0.5]


def test_risk_indices_lose_their_decimals(frame):
    behaviours = ["Low_spent_Small_value_payments", "High_spent_Large_value_payments", None, "High_spent_Medium_value_payments"]
    df = gold.financial_features(silver.clean_financials(financials(frame, Payment_Behaviour=behaviours)))
    got = {r.Customer_ID: (r.Spend_Level_Idx, r.Payment_Value_Level_Idx) for r in df.collect()}
    assert got == {"0": (33, 33), "1": (23, 23), "2": (28, 28), "3": (23, 27)}


def test_demographic_flags(spark):
    rows = [("a", 44, "Lawyer"), ("b", 45, "Beekeeper"), ("c", None, None)]
    got = gold.demographic_features(spark.createDataFrame(rows, "Customer_ID string, Age int, Occupation string")).collect()
    assert [r.Is_Age_gt_45 for r in got] == [0, 1, 0]
    assert [round(r.Occupation_Idx, 2) for r in got] == [26.57, 28.52, 28.52]


def test_features_come_from_the_application_month_only(spark, frame):
    book = loans(spark, [("l", "0", m, 0) for m in range(7)])
    fins = silver.clean_financials(financials(frame, Annual_Income=["100"], snapshot_date=["2023-07-01"]))
    attrs = silver.clean_attributes(frame(", ".join(S.ATTRIBUTES), [("0", "n", "40", "s", "Lawyer", JAN)]))
    clicks = silver.clean_clickstream(frame(", ".join(S.CLICKSTREAM), [("0", "2023-07-01", *["9"] * 20)]))
    row = gold.feature_store(book, clicks, attrs, fins).first()
    assert (row.Annual_Income, row.fe_1, row.Age) == (None, None, 40)
    assert row.__fields__ == S.STORE_COLUMNS and len(S.STORE_COLUMNS) == 48 and len(S.FEATURES) == 41


def test_one_row_per_loan(spark):
    store = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("a", 0)], "loan_id string, label int")
    assert sorted(map(tuple, gold.one_row_per_loan(store).collect())) == [("a", 0), ("b", 2)]


def test_windows_count_back_from_the_snapshot():
    w = training_windows(date(2024, 12, 1))
    assert (w.fit_start, w.fit_end, w.oot_start, w.oot_end) == (
        date(2023, 10, 1), date(2024, 9, 30), date(2024, 10, 1), date(2024, 11, 30),
    )
    assert w.version == "credit_model_2024_12_01"


def test_month_starts():
    got = month_starts(date(2022, 11, 17), date(2023, 2, 1))
    assert got == [date(2022, 11, 1), date(2022, 12, 1), date(2023, 1, 1), date(2023, 2, 1)]


def test_split_is_a_partition_of_the_windows(spark):
    w = training_windows(date(2024, 12, 1))
    months = month_starts(date(2023, 1, 1), date(2025, 6, 1))
    rows = [(f"l{k}", months[k % len(months)], k % 4 == 0) for k in range(6000)]
    store = spark.createDataFrame(rows, "loan_id string, snapshot_date date, bad boolean").selectExpr("*", "int(bad) as label")
    tagged = training.with_split(store, w)
    assert tagged.count() == sum(w.fit_start <= m <= w.oot_end for _, m, _ in rows)
    by_split = {r.split: r for r in training.split_balance(tagged).collect()}
    assert set(by_split) == {"train", "dev", "oot"}
    assert by_split["dev"].n / (by_split["dev"].n + by_split["train"].n) == pytest.approx(0.2, abs=0.03)
    assert by_split["dev"].bad_rate == pytest.approx(by_split["train"].bad_rate, abs=0.05)
