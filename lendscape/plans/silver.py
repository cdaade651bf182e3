"""Silver: types enforced, known junk repaired, one row per key. Months are cleaned together.

Whatever the raw feed defines per monthly file (modal values, one row per customer) is keyed by
``snapshot_date`` here, so any number of months is one plan without a driver round trip.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscape import schemas as S
from lendscape.functions import columns as C
from lendscape.operators.keys import first_per_key, total_order, with_period_modes

PERIOD = "snapshot_date"
KEY = ["Customer_ID", PERIOD]


def typed(df: DataFrame, table: str, prepare=None) -> DataFrame:
    """Cast every known column that is present, in one projection; unparsable text becomes null, unknown columns go."""
    known = S.TABLES[table]

    def column(name: str) -> Column:
        text = C.blank_placeholder(name)
        if prepare is not None:
            text = prepare(name, known[name], text)
        return C.coerce(text, known[name]).alias(name)

    return df.select([column(c) for c in known if c in df.columns])


def with_days_past_due(loans: DataFrame) -> DataFrame:
    """Month on book, installments missed, the first missed date and the days since then.

    Missing numbers become 0 only after the missed installments are worked out of them. A row with
    nothing due has missed nothing, and its days past due are unknown if it is overdue all the same.
    """
    ratio = F.try_divide(F.col("overdue_amt").cast("double"), F.col("due_amt").cast("double"))
    missed = F.coalesce(F.ceil(ratio).try_cast("int"), F.lit(0))
    numeric = [c for c, t in S.LOANS.items() if S.is_number(t)]
    filled = loans.select(
        *[F.coalesce(F.col(c), F.lit(0).cast(S.LOANS[c])).alias(c) if c in numeric else F.col(c) for c in loans.columns],
        F.coalesce("installment_num", F.lit(0)).alias("mob"),
        missed.alias("installments_missed"),
    )
    first_missed = F.when(F.col("installments_missed") > 0, F.add_months(PERIOD, -F.col("installments_missed")))
    dated = filled.withColumn("first_missed_date", first_missed)
    days = F.when(F.col("overdue_amt") > 0, F.date_diff(PERIOD, "first_missed_date")).otherwise(0)
    return dated.withColumn("dpd", days)


def clean_loans(raw: DataFrame) -> DataFrame:
    return with_days_past_due(typed(raw, "loans"))


def clean_attributes(raw: DataFrame) -> DataFrame:
    """Recover the digits of Age; an age out of range or missing becomes the month's modal age."""

    def prepare(name: str, dtype: str, text: Column) -> Column:
        return C.keep_only(text, "0-9-") if name == "Age" else text

    known = typed(raw, "attributes", prepare)
    if "Age" not in known.columns:
        return _one_per_customer(known)
    with_modes = with_period_modes(known, PERIOD, {"Age": S.AGE_RANGE})
    modal = F.coalesce(F.col("_mode_Age").cast("int"), F.lit(S.AGE_DEFAULT))
    age = F.when(C.outside(F.col("Age"), S.AGE_RANGE) | F.col("Age").isNull(), modal).otherwise(F.col("Age"))
    return _one_per_customer(with_modes.select(*[age.alias(c) if c == "Age" else c for c in known.columns]))


def clean_financials(raw: DataFrame) -> DataFrame:
    """Numbers out of text, negatives and outliers repaired column by column, loan types as a list."""

    def prepare(name: str, dtype: str, text: Column) -> Column:
        return C.keep_only(text, "0-9.-") if S.is_number(dtype) else text

    known = typed(raw, "financials", prepare)
    modes = {c: r for c, r in S.MODE_RANGES.items() if c in known.columns}
    with_modes = with_period_modes(known, PERIOD, modes) if modes else known
    types = F.split("Type_of_Loan" if "Type_of_Loan" in known.columns else F.lit(None).cast("string"), r",\s*")

    def repaired(name: str) -> Column:
        column, dtype = F.col(name), S.FINANCIALS[name]
        if name in S.MODE_RANGES:
            modal = F.coalesce(F.col(f"_mode_{name}"), F.lit(S.MODE_DEFAULT)).cast(dtype)
            return F.when(C.outside(column, S.MODE_RANGES[name]), modal).otherwise(column)
        if name == "Num_of_Loan":
            listed = F.coalesce(F.array_size(types), F.lit(0))
            return F.when(C.outside(column, S.NUM_LOANS_RANGE), listed).otherwise(column)
        if name == "Delay_from_due_date":
            return F.abs(column)
        if name == "Type_of_Loan":
            return types
        return C.non_negative(column) if S.is_number(dtype) else column

    return _one_per_customer(with_modes.select(*[repaired(c).alias(c) for c in known.columns]))


def clean_clickstream(raw: DataFrame, run_month: date | None = None) -> DataFrame:
    """Counters as integers, 0 where the feed has none.

    ``run_month`` drops what was logged after it. When months are cleaned together every row
    belongs to its own month's run, so there is nothing to drop. Negative counters carry meaning
    and rows are not de-duplicated.
    """
    rows = typed(raw, "clickstream").filter(F.col("Customer_ID").isNotNull())
    if run_month is not None:
        rows = rows.filter(F.col(PERIOD) <= F.lit(run_month))
    return rows.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in S.CLICK_FEATURES else c for c in rows.columns])


def _one_per_customer(df: DataFrame) -> DataFrame:
    keyed = df.filter(F.col("Customer_ID").isNotNull())
    return first_per_key(keyed, KEY, total_order(keyed))


CLEANERS = {
    "loans": clean_loans,
    "attributes": clean_attributes,
    "financials": clean_financials,
    "clickstream": clean_clickstream,
}
