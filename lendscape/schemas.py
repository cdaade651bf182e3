"""Column types per layer, repair rules and the fixed values every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

CLICK_FEATURES = [f"fe_{i}" for i in range(1, 21)]

# Raw columns and the type each has after cleaning, in file order.
LOANS = {
    "loan_id": "string",
    "Customer_ID": "string",
    "loan_start_date": "date",
    "tenure": "int",
    "installment_num": "int",
    "loan_amt": "float",
    "due_amt": "float",
    "paid_amt": "float",
    "overdue_amt": "float",
    "balance": "float",
    "snapshot_date": "date",
}
ATTRIBUTES = {
    "Customer_ID": "string",
    "Name": "string",
    "Age": "int",
    "SSN": "string",
    "Occupation": "string",
    "snapshot_date": "date",
}
FINANCIALS = {
    "Customer_ID": "string",
    "Annual_Income": "float",
    "Monthly_Inhand_Salary": "float",
    "Num_Bank_Accounts": "int",
    "Num_Credit_Card": "int",
    "Interest_Rate": "float",
    "Num_of_Loan": "int",
    "Type_of_Loan": "string",
    "Delay_from_due_date": "int",
    "Num_of_Delayed_Payment": "int",
    "Changed_Credit_Limit": "float",
    "Num_Credit_Inquiries": "int",
    "Credit_Mix": "string",
    "Outstanding_Debt": "float",
    "Credit_Utilization_Ratio": "float",
    "Credit_History_Age": "string",
    "Payment_of_Min_Amount": "string",
    "Total_EMI_per_month": "float",
    "Amount_invested_monthly": "float",
    "Payment_Behaviour": "string",
    "Monthly_Balance": "float",
    "snapshot_date": "date",
}
CLICKSTREAM = {"Customer_ID": "string", "snapshot_date": "date", **{c: "int" for c in CLICK_FEATURES}}

TABLES = {
    "loans": LOANS,
    "attributes": ATTRIBUTES,
    "financials": FINANCIALS,
    "clickstream": CLICKSTREAM,
}

# Text the feed writes where it has no value.
PLACEHOLDERS = {
    "Occupation": "_______",
    "SSN": "#F%$D@*&8",
    "Payment_Behaviour": "!@9#%8",
    "Credit_Mix": "_",
    "Payment_of_Min_Amount": "NM",
}

# Inclusive valid ranges, and what stands in when a month has no valid value.
AGE_RANGE = (18, 100)
AGE_DEFAULT = 30
MODE_RANGES = {
    "Num_Bank_Accounts": (0, 15),
    "Num_Credit_Card": (0, 15),
    "Interest_Rate": (0, 40),
    "Num_Credit_Inquiries": (0, 25),
}
MODE_DEFAULT = 0
NUM_LOANS_RANGE = (0, 15)

# Numeric financials with a rule of their own; in all others a negative means "unknown".
OWN_RULE = {*MODE_RANGES, "Num_of_Loan", "Delay_from_due_date"}

# Risk index per category, with the index of everything else.
SPEND_RISK = {"Low_spent": 33, "High_spent": 23}
PAYMENT_VALUE_RISK = {"Small_value": 33, "Medium_value": 27, "Large_value": 23}
PAYMENT_RISK_DEFAULT = 28
OCCUPATION_RISK = {
    "Accountant": 30.59,
    "Writer": 30.49,
    "Mechanic": 30.13,
    "Teacher": 29.67,
    "Engineer": 29.51,
    "Manager": 29.48,
    "Entrepreneur": 29.25,
    "Developer": 29.10,
    "Journalist": 29.04,
    "Scientist": 28.64,
    "Doctor": 28.55,
    "Musician": 28.21,
    "Architect": 27.30,
    "Lawyer": 26.57,
    "Media_Manager": 26.28,
}
OCCUPATION_RISK_DEFAULT = 28.52

# The feature store's columns in their published order.
STORE_COLUMNS = [
    "loan_id", "Customer_ID", "label", "label_def", "snapshot_date",
    "Debt_to_Income_Ratio", "EMI_to_Salary_Ratio", "Savings_Propensity",
    "Credit_History_Age_Years", "is_Credit_Age_gt_15", "Num_Bank_Accounts", "Num_Credit_Card",
    "Num_of_Loan", "Interest_Rate", "Monthly_Inhand_Salary", "Annual_Income", "Outstanding_Debt",
    "Credit_Utilization_Ratio", "Total_EMI_per_month", "Amount_invested_monthly", "Monthly_Balance",
    "Is_Age_gt_45", "Age", "Occupation", "Occupation_Idx",
    "Payment_Behaviour", "Spend_Level_Idx", "Payment_Value_Level_Idx",
    *CLICK_FEATURES,
]

# Model inputs follow the store's order: every numeric column from the first ratio on, bar the
# three hand-made indices, then the encoded categories.
_NOT_NUMERIC_INPUT = {
    "Occupation", "Occupation_Idx", "Payment_Behaviour", "Spend_Level_Idx", "Payment_Value_Level_Idx",
}
NUMERIC_FEATURES = [c for c in STORE_COLUMNS[5:] if c not in _NOT_NUMERIC_INPUT]
CATEGORIES = ["Occupation", "Spend_Level", "Payment_Value"]
ENCODED_FEATURES = [f"{c}_TE" for c in CATEGORIES]
FEATURES = NUMERIC_FEATURES + ENCODED_FEATURES

# Features that exist only at the application month, so full coverage proves the anchor.
ANCHOR_FEATURES = [
    "Annual_Income", "Monthly_Inhand_Salary", "Age", "Outstanding_Debt",
    "Credit_History_Age_Years", "Occupation_Idx",
]


def raw_schema(table: str) -> T.StructType:
    """As-received schema: all text, so a month's content can never change its types."""
    return T.StructType([T.StructField(c, T.StringType()) for c in TABLES[table]])


def is_number(dtype: str) -> bool:
    return dtype in ("int", "float")
