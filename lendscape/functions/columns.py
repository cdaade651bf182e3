"""Column expressions: safe casts, text repairs, ratios, durations and derived categories.

Everything is a built-in expression, so it stays inside generated code. ANSI mode stays on: where
bad input has to become null, the ``try_`` form says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendscape import schemas as S


def coerce(text: Column, dtype: str) -> Column:
    """Text to ``dtype``, null where it does not parse. Integers go by way of double: "3.7" is 3."""
    if dtype == "int":
        return text.try_cast("double").try_cast("int")
    return text if dtype == "string" else text.try_cast(dtype)


def keep_only(text: Column, allowed: str) -> Column:
    """Drop every character outside the class ``allowed``. Text that holds no other, as nearly all does, meets no regex."""
    clean = F.ltrim(text, F.lit(allowed.replace("0-9", "0123456789"))) == ""
    return F.when(clean, text).otherwise(F.regexp_replace(text, f"[^{allowed}]", ""))


def blank_placeholder(name: str, column: Column | None = None) -> Column:
    column = F.col(name) if column is None else column
    junk = S.PLACEHOLDERS.get(name)
    return column if junk is None else F.nullif(column, F.lit(junk))


def outside(column: Column, bounds: tuple[float, float]) -> Column:
    """True for values beyond the inclusive bounds, null for null."""
    return ~column.between(*bounds)


def non_negative(column: Column) -> Column:
    return F.when(column >= 0, column)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 when there is nothing to divide by; a missing numerator stays missing."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0))


def or_unknown(column: Column, unknown: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(unknown))


def first_match(text: Column, table: dict[str, object], default: object) -> Column:
    """The entry of the first key ``text`` contains."""
    cases = reduce(
        lambda acc, kv: acc.when(text.contains(kv[0]), F.lit(kv[1])),
        list(table.items())[1:],
        F.when(text.contains(next(iter(table))), F.lit(next(iter(table.values())))),
    )
    return cases.otherwise(F.lit(default))


def spend_level(unknown: str = "Unknown") -> Column:
    names = {k: k.removesuffix("_spent") for k in S.SPEND_RISK}
    return first_match(F.col("Payment_Behaviour"), names, unknown)


def payment_value(unknown: str = "Unknown") -> Column:
    names = {k: k.removesuffix("_value") for k in S.PAYMENT_VALUE_RISK}
    return first_match(F.col("Payment_Behaviour"), names, unknown)


def occupation_risk() -> Column:
    pairs = [F.lit(x) for kv in S.OCCUPATION_RISK.items() for x in kv]
    risk = F.try_element_at(F.create_map(*pairs), F.col("Occupation"))
    return F.coalesce(risk, F.lit(S.OCCUPATION_RISK_DEFAULT)).cast("float")


def history_months(text: Column) -> Column:
    """Months in a duration such as "22 Years and 1 Months"; a missing part counts 0."""

    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(text, rf"(\d+)\s*{unit}", 1).try_cast("int"), F.lit(0))

    return part("Year") * 12 + part("Month")


def whole_years(months: Column) -> Column:
    return F.round(months / 12).cast("int")


def loan_type_name(text: Column) -> Column:
    """A loan type without the list's "and" and without doubled blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\band\b", ""), r"\s+", " "))


def delay_band(days: Column) -> Column:
    # Upper bound of each band and its name.
    bands = [
        (0, "0. On Time or Early"),
        (15, "1. 1-15 Days Late"),
        (30, "2. 16-30 Days Late"),
        (60, "3. 31-60 Days Late"),
    ]
    cases = reduce(lambda acc, b: acc.when(days <= b[0], b[1]), bands[1:], F.when(days <= bands[0][0], bands[0][1]))
    return cases.otherwise("4. > 60 Days Late")


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, rounded half up; exact on ties because the product is an integer."""
    return F.round(F.try_divide(part * 100, whole), places)
