"""Raw credit relations derived from the order tables the checks are given.

An order is a loan, its line numbers are months on book, its customer is the borrower; events are
clicks. All values are text, as a raw feed's are. Integer and modulo rules put in the junk the
cleaners have to meet, so that every engine derives the same rows. ``sql`` writes a relation for
one SQL dialect; ``raw`` runs it on Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lendscape import schemas as S

TITLES = list(S.OCCUPATION_RISK)
EVENT_TYPES = ["view", "signup", "error", "click", "purchase"]


@dataclass(frozen=True)
class Dialect:
    """What the engines write differently."""

    table: Callable[[str], str]
    add_months: Callable[[str, str], str]
    whole: Callable[[str, int], str]
    pick: Callable[[list[str], str], str]


SPARK = Dialect(
    table=lambda name: "{" + name + "}",
    add_months=lambda day, n: f"add_months({day}, cast({n} as int))",
    whole=lambda x, n: f"({x} div {n})",
    pick=lambda items, i: f"element_at(array({', '.join(repr(x) for x in items)}), cast({i} + 1 as int))",
)
DUCK = Dialect(
    table=lambda name: name,
    add_months=lambda day, n: f"cast({day} + to_months(cast({n} as integer)) as date)",
    whole=lambda x, n: f"({x} // {n})",
    pick=lambda items, i: f"([{', '.join(repr(x) for x in items)}])[cast({i} + 1 as integer)]",
)

MONTH = "cast(date_trunc('month', o_orderdate) as date)"


def _text(x: str) -> str:
    return f"cast({x} as varchar(20))"


def _money(cents: str, d: Dialect) -> str:
    return f"concat({_text(d.whole(cents, 100))}, '.', lpad({_text(cents + ' % 100')}, 2, '0'))"


def _loans(d: Dialect) -> str:
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    overdue = f"case when l_returnflag = 'R' then {cents} * cast(floor(l_quantity / 20) as bigint) else 0 end"
    return f"""
with due as (
  select l_orderkey, l_linenumber, cast(sum({cents}) as bigint) as due_c, cast(sum({overdue}) as bigint) as overdue_c
  from {d.table("lineitem")} group by l_orderkey, l_linenumber),
loan as (select o_orderkey, o_custkey, {MONTH} as began from {d.table("orders")})
select {_text("o_orderkey")} as loan_id, {_text("o_custkey")} as Customer_ID, {_text("began")} as loan_start_date,
       '10' as tenure, '0' as installment_num, '10000' as loan_amt, '0' as due_amt, '0' as paid_amt,
       '0' as overdue_amt, '10000' as balance, {_text("began")} as snapshot_date
from loan
union all
select {_text("o_orderkey")}, {_text("o_custkey")}, {_text("began")},
       '10', {_text("l_linenumber")}, '10000', {_money("due_c", d)},
       case when overdue_c = 0 then {_money("due_c", d)} else '0' end,
       case when o_orderkey % 101 = 0 and l_linenumber = 2 then null else {_money("overdue_c", d)} end,
       {_text("10000 - 1000 * l_linenumber")}, {_text(d.add_months("began", "l_linenumber"))}
from loan join due on l_orderkey = o_orderkey"""


def _attributes(d: Dialect) -> str:
    return f"""
with base as (select distinct o_custkey as c, {MONTH} as m from {d.table("orders")}),
rows_in as (
  select c, m, c_name, 0 as copy from base join {d.table("customer")} on c_custkey = c
  union all
  select c, m, c_name, 1 from base join {d.table("customer")} on c_custkey = c where c % 25 = 3)
select case when c % 97 = 5 then null else {_text("c")} end as Customer_ID,
       c_name as Name,
       case when copy = 1 then '33' when c % 17 = 0 then concat({_text("20 + c % 60")}, '_') when c % 23 = 0 then '-500'
            when c % 29 = 0 then '8000' when c % 31 = 0 then null else {_text("18 + c % 50")} end as Age,
       case when c % 11 = 0 then '{S.PLACEHOLDERS["SSN"]}' else concat('000-00-', {_text("1000 + c")}) end as SSN,
       case when c % 13 = 0 then '{S.PLACEHOLDERS["Occupation"]}' when c % 16 = 15 then 'Beekeeper'
            else {d.pick(TITLES, "c % 15")} end as Occupation,
       {_text("m")} as snapshot_date
from rows_in"""


def _financials(d: Dialect) -> str:
    def junk(value: str, every: int) -> str:
        return f"concat({_text(value)}, case when c % {every} = 0 then '_' else '' end)"

    behaviours = [f"{s}_{v}_payments" for s in ("Low_spent", "High_spent") for v in S.PAYMENT_VALUE_RISK]
    return f"""
with base as (
  select o_custkey as c, {MONTH} as m, cast(sum(cast(round(o_totalprice) as bigint)) as bigint) as t
  from {d.table("orders")} group by o_custkey, {MONTH}),
rows_in as (select c, m, t, 0 as copy from base union all select c, m, t, 1 from base where c % 25 = 3)
select case when c % 97 = 5 then null else {_text("c")} end as Customer_ID,
  case when copy = 1 then '1' else {junk("t", 19)} end as Annual_Income,
  case when c % 47 = 0 then '0' else {_text("t % 9000 + 1000")} end as Monthly_Inhand_Salary,
  case when c % 31 = 0 then '-1' when c % 37 = 0 then '1798' else {_text("c % 11")} end as Num_Bank_Accounts,
  case when c % 53 = 0 then '1499' else {_text("c % 12")} end as Num_Credit_Card,
  case when c % 59 = 0 then '5789' else {_text("c % 35 + 1")} end as Interest_Rate,
  case when c % 41 = 0 then '-100' else {_text("c % 8")} end as Num_of_Loan,
  case when c % 8 = 0 then null when c % 8 = 1 then 'Auto Loan'
       else 'Auto Loan, Payday Loan, and Home Equity Loan, Auto Loan' end as Type_of_Loan,
  {_text("c % 70 - 5")} as Delay_from_due_date,
  {junk("c % 28", 9)} as Num_of_Delayed_Payment,
  case when c % 15 = 0 then '_' else {_text("t % 30 - 3")} end as Changed_Credit_Limit,
  case when c % 61 = 0 then '2597' else {_text("c % 17")} end as Num_Credit_Inquiries,
  case when c % 5 = 0 then '{S.PLACEHOLDERS["Credit_Mix"]}' when c % 3 = 0 then 'Good'
       when c % 3 = 1 then 'Standard' else 'Bad' end as Credit_Mix,
  {junk("t % 5000", 23)} as Outstanding_Debt,
  {_text("20 + t % 25")} as Credit_Utilization_Ratio,
  case when c % 43 = 0 then 'NA'
       else concat({_text("c % 33")}, ' Years and ', {_text("c % 12")}, ' Months') end as Credit_History_Age,
  case when c % 10 = 0 then '{S.PLACEHOLDERS["Payment_of_Min_Amount"]}' when c % 2 = 0 then 'Yes' else 'No' end
    as Payment_of_Min_Amount,
  {_text("t % 300")} as Total_EMI_per_month,
  case when c % 21 = 0 then '__10000__' else {_text("t % 700")} end as Amount_invested_monthly,
  case when c % 7 = 0 then '{S.PLACEHOLDERS["Payment_Behaviour"]}' else {d.pick(behaviours, "(c % 7 + 5) % 6")} end
    as Payment_Behaviour,
  case when c % 67 = 0 then '__-333__' else {_text("t % 800")} end as Monthly_Balance,
  {_text("m")} as snapshot_date
from rows_in"""


def _clickstream(d: Dialect) -> str:
    month = d.add_months("cast('1995-01-01' as date)", "event_id % 80")
    amounts = [
        f"sum(case when event_type = '{e}' then cast(floor(value * 100) as bigint) else 0 end)" for e in EVENT_TYPES
    ]
    tallies = [
        f"sum(case when event_id % 15 = {k} then 1 else 0 end) * (case when user_id % 5 = 0 then -1 else 1 end)"
        for k in range(15)
    ]
    features = [f"{_text(f'cast({x} as bigint)')}" for x in amounts + tallies]
    features[2] = f"case when user_id % 11 = 0 then null else {features[2]} end"
    named = ",\n  ".join(f"{x} as {c}" for x, c in zip(features, S.CLICK_FEATURES, strict=True))
    return f"""
select case when user_id % 37 = 4 then null else {_text("user_id")} end as Customer_ID,
  {_text(month)} as snapshot_date,
  {named}
from {d.table("events")} group by user_id, {month}"""


RELATIONS = {"loans": _loans, "attributes": _attributes, "financials": _financials, "clickstream": _clickstream}
SOURCES = {
    "loans": ("orders", "lineitem"),
    "attributes": ("orders", "customer"),
    "financials": ("orders",),
    "clickstream": ("events",),
}


def sql(relation: str, dialect: Dialect) -> str:
    return RELATIONS[relation](dialect)


def given(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables the relations derive from, opened once."""
    names = sorted({t for tables in SOURCES.values() for t in tables})
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}


def raw(spark: SparkSession, tables: dict[str, DataFrame], relation: str) -> DataFrame:
    used = {t: tables[t] for t in SOURCES[relation]}
    return spark.sql(sql(relation, SPARK), **used).select(*S.TABLES[relation])
