"""One test per repair rule and per known trap of the raw feed."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.functions import columns as C
from lendscape.plans import silver

JAN, FEB = "2023-01-01", "2023-02-01"


def attributes(frame, rows):
    return frame("Customer_ID, Name, Age, SSN, Occupation, snapshot_date", rows)


def financials(frame, **columns):
    """One row per position of the given columns; everything else is plain."""
    n = len(next(iter(columns.values())))
    base = {c: ["1"] * n for c in S.FINANCIALS} | {
        "Customer_ID": [str(k) for k in range(n)],
        "snapshot_date": [JAN] * n,
        "Type_of_Loan": ["Auto Loan"] * n,
    }
    base |= columns
    return frame(", ".join(S.FINANCIALS), list(zip(*[base[c] for c in S.FINANCIALS], strict=True)))


def loan(frame, **values):
    base = {
        "loan_id": "L", "Customer_ID": "C", "loan_start_date": JAN, "tenure": "10", "installment_num": "3",
        "loan_amt": "100", "due_amt": "10", "paid_amt": "0", "overdue_amt": "0", "balance": "100", "snapshot_date": "2023-04-01",
    } | values
    return silver.clean_loans(frame(", ".join(S.LOANS), [[base[c] for c in S.LOANS]])).first()


def column(df, name, key="Customer_ID"):
    return {r[key]: r[name] for r in df.collect()}


def test_age_bounds_junk_and_missing(frame):
    ages = ["17", "18", "100", "101", "28_", "-500", None, "", "28", "23.0"]
    rows = [(str(k), "n", a, "s", "o", JAN) for k, a in enumerate(ages)]
    got = column(silver.clean_attributes(attributes(frame, rows)), "Age")
    # The modal valid age is 28; a decimal point is dropped with the junk, so "23.0" reads 230.
    assert got == {"0": 28, "1": 18, "2": 100, "3": 28, "4": 28, "5": 28, "6": 28, "7": 28, "8": 28, "9": 28}


def test_age_falls_back_when_a_month_has_no_valid_age(frame):
    rows = [("a", "n", "-1", "s", "o", JAN), ("b", "n", "40", "s", "o", FEB)]
    assert column(silver.clean_attributes(attributes(frame, rows)), "Age") == {"a": 30, "b": 40}


def test_mode_is_per_month_and_takes_the_lowest_of_ties(frame):
    rows = [("a", "n", "50", "s", "o", JAN), ("b", "n", "40", "s", "o", JAN), ("c", "n", "x", "s", "o", JAN),
            ("d", "n", "60", "s", "o", FEB), ("e", "n", "999", "s", "o", FEB)]
    got = column(silver.clean_attributes(attributes(frame, rows)), "Age")
    assert (got["c"], got["e"]) == (40, 60)


def test_placeholders_become_null(frame):
    rows = [("a", "n", "20", S.PLACEHOLDERS["SSN"], S.PLACEHOLDERS["Occupation"], JAN), ("b", "n", "20", "1", "Lawyer", JAN)]
    got = {r.Customer_ID: (r.SSN, r.Occupation) for r in silver.clean_attributes(attributes(frame, rows)).collect()}
    assert got == {"a": (None, None), "b": ("1", "Lawyer")}
    marks = [c for c in ("Payment_Behaviour", "Credit_Mix", "Payment_of_Min_Amount")]
    df = silver.clean_financials(financials(frame, **{c: [S.PLACEHOLDERS[c], "kept"] for c in marks}))
    assert {tuple(r[c] for c in marks) for r in df.collect()} == {(None,) * 3, ("kept",) * 3}


def test_null_key_dropped_and_duplicates_reduced_deterministically(frame):
    rows = [(None, "n", "20", "s", "o", JAN), ("a", "z", "20", "s", "o", JAN), ("a", "b", "20", "s", "o", JAN),
            ("a", "z", "20", "s", "o", FEB)]
    for order in (rows, rows[::-1]):
        got = silver.clean_attributes(attributes(frame, order)).orderBy("snapshot_date").collect()
        assert [(r.Customer_ID, r.Name, str(r.snapshot_date)) for r in got] == [("a", "b", JAN), ("a", "z", FEB)]


@pytest.mark.parametrize(
    ("name", "values", "expected"),
    [
        ("Num_Bank_Accounts", ["-1", "0", "15", "16", "0", None], [0, 0, 15, 0, 0, None]),
        ("Num_Credit_Card", ["1499", "3", "3_"], [3, 3, 3]),
        ("Interest_Rate", ["40", "41", "40"], [40.0, 40.0, 40.0]),
        ("Num_Credit_Inquiries", ["25", "26", "-2"], [25, 25, 25]),
        ("Delay_from_due_date", ["-5", "5", None], [5, 5, None]),
        ("Monthly_Balance", ["__-333__", "12.5", "x"], [None, 12.5, None]),
        ("Num_of_Delayed_Payment", ["3.7", "-1", "8_"], [3, None, 8]),
        ("Amount_invested_monthly", ["__10000__", "-", "1-2"], [10000.0, None, None]),
    ],
)
def test_financial_repairs(frame, name, values, expected):
    got = column(silver.clean_financials(financials(frame, **{name: values})), name)
    assert [got[str(k)] for k in range(len(values))] == expected


def test_mode_defaults_to_zero_without_valid_rows(frame):
    assert column(silver.clean_financials(financials(frame, Num_Bank_Accounts=["99", "-1"])), "Num_Bank_Accounts") == {"0": 0, "1": 0}


def test_loan_count_falls_back_to_listed_types(frame):
    df = financials(frame, Num_of_Loan=["-100", "1496", "3", "16"], Type_of_Loan=["Auto Loan, and Payday Loan", None, "x", "a,b,  c"])
    cleaned = silver.clean_financials(df)
    assert column(cleaned, "Num_of_Loan") == {"0": 2, "1": 0, "2": 3, "3": 3}
    assert column(cleaned, "Type_of_Loan")["3"] == ["a", "b", "c"]


def test_repairs_are_idempotent(spark, frame):
    df = financials(frame, Num_Bank_Accounts=["99", "4", "4"], Monthly_Balance=["-1", "2", "3"], Delay_from_due_date=["-5", "1", "2"])
    once = silver.clean_financials(df)
    text = once.select(*[F.array_join(c, ", ").alias(c) if c == "Type_of_Loan" else F.col(c).cast("string") for c in once.columns])
    assert sorted(map(str, silver.clean_financials(text).collect())) == sorted(map(str, once.collect()))


def test_days_past_due(frame):
    assert loan(frame, overdue_amt="0").dpd == 0
    late = loan(frame, overdue_amt="25")
    assert (late.installments_missed, late.first_missed_date, late.dpd) == (3, date(2023, 1, 1), 90)
    assert loan(frame, overdue_amt="10", snapshot_date="2023-03-31").first_missed_date == date(2023, 2, 28)


def test_nothing_due_means_nothing_missed(frame):
    assert (loan(frame, due_amt="0", overdue_amt="0").installments_missed, loan(frame, due_amt="0").dpd) == (0, 0)
    unknown = loan(frame, due_amt="0", overdue_amt="5")
    assert (unknown.installments_missed, unknown.dpd) == (0, None)


def test_loans_fill_every_number_after_deriving(frame):
    row = loan(frame, overdue_amt=None, tenure="", balance="junk", installment_num=None)
    assert (row.overdue_amt, row.tenure, row.balance, row.mob, row.installments_missed, row.dpd) == (0, 0, 0, 0, 0, 0)


def test_clickstream_guard_and_fill(frame):
    columns = ["Customer_ID", "snapshot_date", *S.CLICK_FEATURES]
    rows = [("a", JAN, *["1"] * 20), ("a", FEB, *["2"] * 20), (None, JAN, *["3"] * 20), ("b", JAN, None, "-7", *["x"] * 18)]
    df = silver.clean_clickstream(frame(", ".join(columns), rows), date(2023, 1, 1))
    got = {r.Customer_ID: (r.fe_1, r.fe_2, r.fe_20) for r in df.collect()}
    assert got == {"a": (1, 1, 1), "b": (0, -7, 0)}


def test_absent_columns_are_skipped(frame):
    assert silver.clean_attributes(frame("Customer_ID, Age, snapshot_date", [("a", "40", JAN)])).columns == [
        "Customer_ID", "Age", "snapshot_date",
    ]


@pytest.mark.parametrize(
    ("text", "months", "years"),
    [("22 Years and 1 Months", 265, 22), ("NA", 0, 0), (None, 0, 0), ("1 Year", 12, 1), ("0 Years and 6 Months", 6, 1), ("11 Months", 11, 1)],
)
def test_duration(frame, text, months, years):
    m = C.history_months(F.col("t"))
    row = frame("t", [(text,)]).select(m.alias("m"), C.whole_years(m).alias("y")).first()
    assert (row.m, row.y) == (months, years)


@pytest.mark.parametrize(
    ("text", "name"), [(" and  Home  Equity Loan", "Home Equity Loan"), ("Android Loan", "Android Loan"), ("AND", "")]
)
def test_loan_type_name(frame, text, name):
    assert frame("t", [(text,)]).select(C.loan_type_name(F.col("t"))).first()[0] == name
