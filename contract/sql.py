"""Independent answers in DuckDB SQL, one per registered query that SQL can express.

Written from the definitions, not from the Spark plans: ranks instead of running sums, one window
per repair instead of grouped modes, plain joins, whole tables.
"""

from __future__ import annotations

from lendscape import schemas as S
from lendscape.sources import sample

CLICKS = S.CLICK_FEATURES
SNAPSHOT = "date '2001-01-01'"
FIT, OOT = ("date '1999-11-01'", "date '2000-10-31'"), ("date '2000-11-01'", "date '2000-12-31'")
RUN_MONTH = "date '2000-01-01'"
AS_OF = "date '2026-11-01'"


def half_up(num: str, den: str, places: int) -> str:
    """num / den for whole numbers, rounded half away from zero without binary error; null over 0."""
    scale = 10**places
    n, d = f"cast({num} as hugeint)", f"cast({den} as hugeint)"
    return (
        f"case when {d} = 0 then null else "
        f"cast(sign({n}) * ((abs({n}) * {2 * scale} + {d}) // (2 * {d})) as double) / {scale} end"
    )


def whole(text: str) -> str:
    return f"cast(trunc(try_cast({text} as double)) as integer)"


def day(column: str) -> str:
    return f"cast({column} as varchar) as {column.split('.')[-1]}"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def long(table: str, columns: list[str], *keep: str, kind: str = "double") -> str:
    kept = "".join(f"{k}, " for k in keep)
    return union([f"select {kept}'{c}' as feature, cast({c} as {kind}) as value from {table}" for c in columns])


def casts(table: str) -> str:
    out = []
    for c, t in S.TABLES[table].items():
        x = {"int": whole(c), "string": c}.get(t, f"try_cast({c} as {t})")
        out.append(f"{x} as {c}")
    return ", ".join(out)


CTE: dict[str, str] = {f"raw_{r}": sample.sql(r, sample.DUCK) for r in sample.RELATIONS}

LOAN_NUMBERS = [c for c, t in S.LOANS.items() if S.is_number(t)]
CTE["loans"] = f"""
with t as (select {casts("loans")} from raw_loans),
m as (select *, cast(case when due_amt is null or due_amt = 0 or overdue_amt is null then 0
        else ceil(cast(overdue_amt as double) / cast(due_amt as double)) end as integer) as installments_missed from t),
f as (select * replace ({", ".join(f"coalesce({c}, 0) as {c}" for c in LOAN_NUMBERS)}) from m),
d as (select *, installment_num as mob,
        case when installments_missed > 0
             then cast(snapshot_date - to_months(installments_missed) as date) end as first_missed_date from f)
select *, cast(case when overdue_amt > 0 then date_diff('day', first_missed_date, snapshot_date) else 0 end as integer) as dpd
from d"""

CTE["attributes"] = f"""
with t as (select Customer_ID, Name, nullif(SSN, '{S.PLACEHOLDERS["SSN"]}') as SSN,
    nullif(Occupation, '{S.PLACEHOLDERS["Occupation"]}') as Occupation,
    try_cast(regexp_replace(Age, '[^0-9-]', '', 'g') as integer) as a, cast(snapshot_date as date) as snapshot_date
  from raw_attributes),
c as (select snapshot_date, a, count(*) as n from t where a between 18 and 100 group by snapshot_date, a),
mode as (select snapshot_date, a as modal from c
  qualify row_number() over (partition by snapshot_date order by n desc, a) = 1),
r as (select Customer_ID, Name, case when a between 18 and 100 then a else coalesce(modal, 30) end as Age,
    SSN, Occupation, snapshot_date from t left join mode using (snapshot_date) where Customer_ID is not null)
select * from r qualify row_number() over (partition by Customer_ID, snapshot_date order by
  Name nulls first, Age nulls first, SSN nulls first, Occupation nulls first) = 1"""


def _number(c: str) -> str:
    text = f"regexp_replace({c}, '[^0-9.-]', '', 'g')"
    return whole(text) if S.FINANCIALS[c] == "int" else f"try_cast({text} as float)"


def _financials() -> str:
    numbers = [c for c, t in S.FINANCIALS.items() if S.is_number(t)]
    typed = ", ".join(
        f"{_number(c)} as {c}" if c in numbers
        else f"nullif({c}, '{S.PLACEHOLDERS[c]}') as {c}" if c in S.PLACEHOLDERS
        else f"cast({c} as {t}) as {c}" if t == "date" else c
        for c, t in S.FINANCIALS.items()
    )
    modes, joins, fixes = [], [], []
    for c, (lo, hi) in S.MODE_RANGES.items():
        modes.append(
            f"m_{c} as (select snapshot_date, {c} as modal_{c} from (select snapshot_date, {c}, count(*) as n from t "
            f"where {c} between {lo} and {hi} group by all) qualify row_number() over "
            f"(partition by snapshot_date order by n desc, {c}) = 1)"
        )
        joins.append(f"left join m_{c} using (snapshot_date)")
        fixes.append(f"case when {c} not between {lo} and {hi} then coalesce(modal_{c}, 0) else {c} end as {c}")
    fixes.append("abs(Delay_from_due_date) as Delay_from_due_date")
    fixes.append(
        "case when Num_of_Loan not between 0 and 15 then coalesce(len(regexp_split_to_array(Type_of_Loan, ',\\s*')), 0) "
        "else Num_of_Loan end as Num_of_Loan"
    )
    fixes.append("regexp_split_to_array(Type_of_Loan, ',\\s*') as Type_of_Loan")
    fixes += [f"case when {c} >= 0 then {c} end as {c}" for c in numbers if c not in S.OWN_RULE]
    order = ", ".join(f"{c} nulls first" for c in S.FINANCIALS)
    return f"""
with t as (select {typed} from raw_financials),
{", ".join(modes)},
r as (select * exclude ({", ".join(f"modal_{c}" for c in S.MODE_RANGES)}) replace ({", ".join(fixes)})
  from t {" ".join(joins)} where Customer_ID is not null)
select {", ".join(S.FINANCIALS)} from r
qualify row_number() over (partition by Customer_ID, snapshot_date order by {order}) = 1"""


CTE["financials"] = _financials()
CTE["clickstream"] = f"""
select Customer_ID, cast(snapshot_date as date) as snapshot_date,
  {", ".join(f"coalesce({whole(c)}, 0) as {c}" for c in CLICKS)}
from raw_clickstream where Customer_ID is not null"""

CTE["labels"] = """
with w as (select Customer_ID, loan_id, max(dpd) as max_dpd, max(mob) as max_mob from loans
  where mob between 1 and 6 group by Customer_ID, loan_id),
a as (select Customer_ID, loan_id, snapshot_date from loans where installment_num = 0)
select loan_id, Customer_ID, case when max_dpd >= 30 then 1 else 0 end as label,
  '30dpd_within_6mob' as label_def, snapshot_date, max_dpd
from w join a using (Customer_ID, loan_id) where max_mob >= 6"""


def ratio(num: str, den: str) -> str:
    return f"case when {den} > 0 then cast({num} as double) / cast({den} as double) else 0.0 end"


def contains(table: dict, default: object, quote: str = "") -> str:
    whens = " ".join(f"when contains(Payment_Behaviour, '{k}') then {quote}{v}{quote}" for k, v in table.items())
    return f"case {whens} else {quote}{default}{quote} end"


SPEND = {"Low_spent": "Low", "High_spent": "High"}
VALUE = {"Small_value": "Small", "Medium_value": "Medium", "Large_value": "Large"}
RATIOS = f"""{ratio("Outstanding_Debt", "Annual_Income")} as Debt_to_Income_Ratio,
  {ratio("Total_EMI_per_month", "Monthly_Inhand_Salary")} as EMI_to_Salary_Ratio,
  case when Monthly_Inhand_Salary > 0 then
    (coalesce(cast(Monthly_Balance as double), 0) + coalesce(cast(Amount_invested_monthly as double), 0))
    / cast(Monthly_Inhand_Salary as double) else 0.0 end as Savings_Propensity"""
MONTHS = (
    "(12 * coalesce(try_cast(regexp_extract(Credit_History_Age, '(\\d+)\\s*Year', 1) as integer), 0)"
    " + coalesce(try_cast(regexp_extract(Credit_History_Age, '(\\d+)\\s*Month', 1) as integer), 0))"
)
YEARS = f"cast({half_up(MONTHS, '12', 0)} as integer)"
OCCUPATION = (
    "cast(case Occupation "
    + " ".join(f"when '{k}' then {v}" for k, v in S.OCCUPATION_RISK.items())
    + f" else {S.OCCUPATION_RISK_DEFAULT} end as float)"
)
INDICES = f"""{contains(S.SPEND_RISK, 28)} as Spend_Level_Idx, {contains(S.PAYMENT_VALUE_RISK, 28)} as Payment_Value_Level_Idx"""
CTE["fin_features"] = f"""select *, {RATIOS}, {INDICES}, {MONTHS} as Credit_History_Age_Months,
  {YEARS} as Credit_History_Age_Years, case when {YEARS} > 15 then 1 else 0 end as is_Credit_Age_gt_15 from financials"""
CTE["attr_features"] = f"""select *, case when Age >= 45 then 1 else 0 end as Is_Age_gt_45, {OCCUPATION} as Occupation_Idx
  from attributes"""
CTE["store"] = f"""select {", ".join(S.STORE_COLUMNS)} from labels
  left join fin_features using (Customer_ID, snapshot_date)
  left join clickstream using (Customer_ID, snapshot_date)
  left join attr_features using (Customer_ID, snapshot_date)"""
CTE["flags"] = """select Customer_ID, overdue_amt, case when overdue_amt > 0 then 1 else 0 end as isDefault from loans
  qualify row_number() over (partition by Customer_ID order by snapshot_date desc, loan_id, overdue_amt desc) = 1"""
for _name in ("financials", "attributes", "clickstream"):
    CTE[f"flagged_{_name}"] = f"select * from {_name} join (select Customer_ID, isDefault from flags) using (Customer_ID)"
CTE["predictions"] = """select *, k / cast(1000 as double) as model_predict_proba, cast(k >= 500 as integer) as model_predict_label
  from (select loan_id, Customer_ID, snapshot_date, label, 'credit_model_2001_01_01' as model_version,
    cast(loan_id as bigint) * 7919 % 700 + label * 200
    + (extract(year from snapshot_date) - 1995) * 12 + extract(month from snapshot_date) - 1 as k from labels)"""
CTE["tagged"] = f"""select *, case when snapshot_date between {OOT[0]} and {OOT[1]} then 'oot'
    when cast('0x' || substr(md5(loan_id || '-88'), 1, 8) as bigint) < 0.2 * 4294967296 then 'dev' else 'train' end as split
  from store where snapshot_date between {FIT[0]} and {OOT[1]}"""
CTE["categorised"] = f"""select * replace (coalesce(Occupation, 'Unknown') as Occupation),
    {contains(SPEND, "Unknown", "'")} as Spend_Level, {contains(VALUE, "Unknown", "'")} as Payment_Value from tagged"""
CTE["medians"] = "select " + ", ".join(
    f"quantile_cont(cast({c} as double), 0.5) as {c}" for c in S.NUMERIC_FEATURES
) + " from categorised where split = 'train'"
CTE["encoding"] = f"""with g as (select avg(label) as overall from categorised where split = 'train')
  select feature, category, n, (bad + overall * 20) / (n + 20) as encoded, overall from (
    select feature, category, sum(label) as bad, count(*) as n from (
      {union([f"select label, '{c}' as feature, {c} as category from categorised where split = 'train'" for c in S.CATEGORIES])})
    group by feature, category), g"""
CTE["matrix"] = (
    "select c.loan_id, c.split, c.label, "
    + ", ".join(f"coalesce(cast(c.{f} as double), medians.{f}) as {f}" for f in S.NUMERIC_FEATURES)
    + ", "
    + ", ".join(f"coalesce((select encoded from encoding where feature = '{f}' and category = c.{f}), "
                "(select max(overall) from encoding)) as " + f"{f}_TE" for f in S.CATEGORIES)
    + " from categorised c, medians"
)

NEEDS = {
    "loans": ["raw_loans"],
    "attributes": ["raw_attributes"],
    "financials": ["raw_financials"],
    "clickstream": ["raw_clickstream"],
    "labels": ["loans"],
    "fin_features": ["financials"],
    "attr_features": ["attributes"],
    "store": ["labels", "fin_features", "clickstream", "attr_features"],
    "flags": ["loans"],
    "flagged_financials": ["financials", "flags"],
    "flagged_attributes": ["attributes", "flags"],
    "flagged_clickstream": ["clickstream", "flags"],
    "predictions": ["labels"],
    "tagged": ["store"],
    "categorised": ["tagged"],
    "medians": ["categorised"],
    "encoding": ["categorised"],
    "matrix": ["categorised", "medians", "encoding"],
}


def with_needs(tables: list[str], body: str) -> str:
    done: list[str] = []

    def add(t: str) -> None:
        for n in NEEDS.get(t, []):
            add(n)
        if t not in done:
            done.append(t)

    for t in tables:
        add(t)
    head = ",\n".join(f"{t} as ({CTE[t]})" for t in done)
    return f"with {head}\n{body}" if done else body


def plain(types: dict[str, str], *skip: str) -> str:
    """Columns as the registry returns them: dates as text, floats as doubles, lists joined."""
    out = []
    for c, t in types.items():
        if c in skip:
            continue
        if c == "Type_of_Loan":
            out.append(f"array_to_string({c}, '|') as {c}")
        elif t == "date":
            out.append(day(c))
        elif t == "float":
            out.append(f"cast({c} as double) as {c}")
        else:
            out.append(c)
    return ", ".join(out)


def rate(num: str = "sum(isDefault)", den: str = "count(*)", places: int = 2) -> str:
    return half_up(f"{num} * 100", den, places) + " as Default_Rate_Percent"


def by(table: str, key: str, alias: str, where: str = "true", count_as: str = "Total_Customers", extra: str = "") -> str:
    return (
        f"select {key} as {alias}, count(*) as {count_as}, cast(sum(isDefault) as bigint) as Total_Defaults, {rate()}{extra} "
        f"from {table} where {where} group by {key}"
    )


def buckets(rows: str, n: int, places: int) -> str:
    """Default rate per bucket of (feature, value, isDefault) rows, by sorting each feature whole."""
    shares = ", ".join(str(k / n) for k in range(1, n))
    return f"""
with v as ({rows}), u as (select * from v where value is not null),
e as (select feature, list_distinct(list_transform(quantile_cont(value, [{shares}]), lambda x: round(x, 9))) as edges
  from u group by feature),
b as (select u.*, len(list_filter(edges, lambda x: x <= value)) as bucket from u join e using (feature))
select feature, bucket, count(*) as Total_Customers, cast(sum(isDefault) as bigint) as Total_Defaults, {rate()},
  {half_up("sum(cast(value as bigint))", "count(*)", places)} as Avg_Value from b group by feature, bucket"""


def ranked_auc(rows: str, group: str, score: str) -> str:
    """Twice the rank-sum statistic and twice the number of pairs, per group."""
    return f"""select {group}, p, n, num, 2 * p * n as den from (
  select {group}, sum(label) as p, sum(1 - label) as n, sum(case when label = 1 then r2 else 0 end)
      - sum(label) * (sum(label) + 1) as num, count(distinct {score}) as n_values from (
    select *, 2 * rank() over (partition by {group} order by {score})
      + count(*) over (partition by {group}, {score}) - 1 as r2 from ({rows})) group by {group})"""


MONITORING = f"""
mm as (select cast(date_trunc('month', snapshot_date) as date) as month, * from predictions),
vol as (select month, count(*) as n from mm group by month),
base as (select coalesce(min(case when n >= 50 then month end), min(month)) as b from vol),
edges as (select list_sort(list_distinct(list_transform(
    quantile_cont(model_predict_proba, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]), lambda x: round(x, 9)))) as e
  from mm, base where month = b),
bins as (select month, len(list_filter(e[2:len(e) - 1], lambda x: x <= model_predict_proba)) as bin from mm, edges),
cnt as (select month, bin, count(*) as c from bins group by month, bin),
grid as (select month, bin from vol, (select unnest(range(0, 10)) as bin)),
shares as (select g.month, g.bin, greatest(coalesce(c, 0) / cast(n as double), 1e-6) as s
  from grid g join vol using (month) left join cnt using (month, bin)),
psi as (select a.month, round(sum((a.s - x.s) * ln(a.s / x.s)), 4) as psi_vs_baseline
  from shares a join shares x on a.bin = x.bin join base on x.month = b group by a.month),
auc as ({ranked_auc("select * from mm", "month", "model_predict_proba")})"""


def monitoring(final: str) -> str:
    return with_needs(["predictions"], "").rstrip() + "," + MONITORING + "\n" + final


MONTHLY = f"""select {day("v.month")}, v.n as n_records,
  (select {half_up("sum(label)", "count(*)", 4)} from mm where mm.month = v.month) as actual_bad_rate,
  (select {half_up("sum(k)", "1000 * count(*)", 4)} from mm where mm.month = v.month) as avg_predicted_proba,
  {half_up("num", "den", 4)} as auc, {half_up("2 * num - den", "den", 4)} as gini, psi_vs_baseline
from vol v join auc on auc.month = v.month join psi on psi.month = v.month"""


# Answers


def _store_types() -> dict[str, str]:
    floats = {c for c, t in {**S.FINANCIALS, **S.ATTRIBUTES}.items() if t == "float"} | {"Occupation_Idx"}
    return {c: "float" if c in floats else "date" if c == "snapshot_date" else "other" for c in S.STORE_COLUMNS}


KEY = f"Customer_ID, {day('snapshot_date')}"
LOANS_OUT = plain({**S.LOANS, "mob": "int", "installments_missed": "int", "first_missed_date": "date", "dpd": "int"})
AS_OF_MONTHS = f"({MONTHS} + date_diff('month', snapshot_date, {AS_OF}))"
AS_OF_YEARS = f"cast({half_up(AS_OF_MONTHS, '12', 0)} as integer)"
UNKNOWN_BEHAVIOUR = "coalesce(nullif(nullif(Payment_Behaviour, ''), '!@9#%8'), 'UNKNOWN')"
INQUIRIES = "Num_Credit_Inquiries >= 0 and Amount_invested_monthly >= 0 and Monthly_Balance is not null"
TYPES = """select Customer_ID, trim(regexp_replace(regexp_replace(t, '\\band\\b', '', 'gi'), '\\s+', ' ', 'g')) as
  Single_Loan_Type from (select Customer_ID, unnest(Type_of_Loan) as t from financials where {where})"""
PREDICTIONS_OUT = f"loan_id, Customer_ID, {day('snapshot_date')}, label, model_version, model_predict_proba, model_predict_label"
SUM_FLAGS = "cast(sum(isDefault) as bigint)"


def _typed_long(table: str, columns: list[str], kind: str) -> str:
    return union([f"select '{c}' as feature, try_cast({c} as {kind}) as value from {table}" for c in columns])


def _window_rows(table: str) -> str:
    return (
        f"select {day('snapshot_date')}, '{table}' as table_name, count(*) as n_rows from {table} "
        "where snapshot_date between date '1996-01-01' and date '2000-12-01' group by snapshot_date"
    )


def _flagged_long(table: str, columns: list[str], where: str = "true") -> str:
    return union(
        [f"select '{c}' as feature, cast({c} as double) as value, isDefault from {table} where {where}" for c in columns]
    )


def _frequency(table: str, columns: list[str]) -> str:
    return with_needs(
        [table], f"select feature, value, count(*) as n from ({_typed_long(table, columns, 'varchar')}) where value is not null group by all"
    )


def _duplicates(table: str, keys: str) -> str:
    return f"select count(*) - count(distinct row({keys})) from {table}"


def _overlap(a: str, b: str) -> str:
    pick = "select distinct Customer_ID from tagged where split = '{}'"
    return f"(select count(*) from ({pick.format(a)} intersect {pick.format(b)}))"


PAIRS = [("train", "dev"), ("train", "oot"), ("dev", "oot")]
TRAIN_LONG = f"select * from ({long('matrix', S.FEATURES, 'label', 'split')}) where split = 'train'"
UNIVARIATE = f"""select feature, round(greatest(num / cast(den as double), 1 - num / cast(den as double)), 6) as univariate_auc
  from ({ranked_auc(TRAIN_LONG, "feature", "value")}) where den > 0 and p + n >= 50
    and feature in (select feature from ({TRAIN_LONG}) group by feature having count(distinct value) >= 2)"""
SCALES = f"""select feature, avg(value) as mean,
  case when stddev_pop(value) > 0 then stddev_pop(value) else 1.0 end as std from ({TRAIN_LONG}) group by feature"""
CORRELATION = f"""select feature, round(corr(value, isDefault), 6) as correlation
  from ({_flagged_long("flagged_clickstream", CLICKS)}) group by feature having var_pop(value) > 0 and var_pop(isDefault) > 0"""


def _check(name: str, value: str, allowed: float, sign: str = "<=") -> str:
    return (
        f"select '{name}' as check_name, cast({value} as double) as value, cast({allowed} as double) as allowed, "
        f"cast({value} {sign} {allowed} as integer) as passed"
    )


def _covered(c: str, source: str = "store") -> str:
    return f"(select {half_up(f'100 * count({c})', 'count(*)', 1)} from {source})"


MAX_LOANS = "(select max(n) from (select count(distinct loan_id) as n from store where Customer_ID is not null group by Customer_ID))"

ANSWERS: dict[str, str] = {
    "snapshot_ingest": with_needs(["raw_loans"], f"select {', '.join(S.LOANS)} from raw_loans"),
    "month_calendar_rows": with_needs(
        ["loans"],
        "select cast(unnest(generate_series(min(snapshot_date), max(snapshot_date), interval 1 month)) as date)::varchar as month from loans",
    ),
    "window_load": with_needs(list(S.TABLES), union([_window_rows(t) for t in S.TABLES])),
    "loans_dpd": with_needs(["loans"], f"select {LOANS_OUT} from loans"),
    "clean_attributes": with_needs(["attributes"], f"select {plain(S.ATTRIBUTES)} from attributes"),
    "clean_financials": with_needs(["financials"], f"select {plain(S.FINANCIALS)} from financials"),
    "clean_clickstream": with_needs(
        ["clickstream"], f"select {plain(S.CLICKSTREAM)} from clickstream where snapshot_date <= {RUN_MONTH}"
    ),
    "loan_type_array": with_needs(
        ["financials"],
        f"select {KEY}, array_to_string(Type_of_Loan, '|') as Type_of_Loan, coalesce(len(Type_of_Loan), 0) as n_types, "
        "Num_of_Loan from financials",
    ),
    "default_labels": with_needs(
        ["labels"], f"select loan_id, Customer_ID, label, label_def, {day('snapshot_date')}, max_dpd from labels"
    ),
    "application_rows": with_needs(
        ["loans"], f"select Customer_ID, loan_id, {day('snapshot_date')} from loans where installment_num = 0"
    ),
    "bad_rate_by_app_month": with_needs(
        ["labels"],
        f"select {day('snapshot_date')}, count(*) as n_loans, cast(sum(label) as bigint) as Total_Defaults, "
        f"{rate('sum(label)')} from labels group by labels.snapshot_date",
    ),
    "feature_ratios": with_needs(
        ["fin_features"], f"select {KEY}, Debt_to_Income_Ratio, EMI_to_Salary_Ratio, Savings_Propensity from fin_features"
    ),
    "risk_indices": with_needs(
        ["fin_features", "attr_features"],
        f"select Customer_ID, {day('f.snapshot_date')}, Spend_Level_Idx, Payment_Value_Level_Idx, "
        "cast(Occupation_Idx as double) as Occupation_Idx, Is_Age_gt_45 from fin_features f "
        "join attr_features a using (Customer_ID, snapshot_date)",
    ),
    "credit_history_age": with_needs(
        ["fin_features"],
        f"select {KEY}, Credit_History_Age, Credit_History_Age_Months, Credit_History_Age_Years, is_Credit_Age_gt_15 "
        "from fin_features",
    ),
    "credit_history_asof": with_needs(
        ["financials"],
        f"select {KEY}, Credit_History_Age, cast({AS_OF_MONTHS} as double) as Credit_History_Age_Months, "
        f"{AS_OF_YEARS} as Credit_History_Age_Years from financials",
    ),
    "derived_categoricals": with_needs(
        ["store"],
        f"select loan_id, coalesce(Occupation, 'Unknown') as Occupation, {contains(SPEND, 'Unknown', chr(39))} as Spend_Level, "
        f"{contains(VALUE, 'Unknown', chr(39))} as Payment_Value from store",
    ),
    "gold_feature_store": with_needs(["store"], f"select {plain(_store_types())} from store"),
    "latest_default_label": with_needs(
        ["flags"], "select Customer_ID, cast(overdue_amt as double) as overdue_amt, isDefault from flags"
    ),
    "bad_rate_by_num_loans": with_needs(
        ["flagged_financials"], by("flagged_financials", "Num_of_Loan", "Num_of_Loan", "Num_of_Loan >= 0")
    ),
    "bad_rate_by_bank_accounts": with_needs(
        ["flagged_financials"], by("flagged_financials", "Num_Bank_Accounts", "Num_Bank_Accounts", "Num_Bank_Accounts >= 0")
    ),
    "bad_rate_by_credit_cards": with_needs(
        ["flagged_financials"], by("flagged_financials", "Num_Credit_Card", "Num_Credit_Card", "Num_Credit_Card >= 0")
    ),
    "bad_rate_by_age": with_needs(["flagged_attributes"], by("flagged_attributes", "Age", "Age", "Age > 0 and Age < 100")),
    "bad_rate_by_occupation": with_needs(
        ["flagged_attributes"], by("flagged_attributes", "coalesce(nullif(Occupation, ''), 'UNKNOWN')", "Occupation_Clean")
    ),
    "bad_rate_by_payment_behaviour": with_needs(
        ["flagged_financials"], by("flagged_financials", UNKNOWN_BEHAVIOUR, "Payment_Behaviour_Clean")
    ),
    "bad_rate_by_spend_level": with_needs(
        ["flagged_financials"], by("flagged_financials", contains(SPEND, "UNKNOWN", "'"), "Spend_Level")
    ),
    "bad_rate_by_payment_value": with_needs(
        ["flagged_financials"], by("flagged_financials", contains(VALUE, "UNKNOWN", "'"), "Payment_Value")
    ),
    "bad_rate_by_credit_age": with_needs(
        ["flagged_financials"], by("flagged_financials", YEARS, "Credit_History_Age_Years", f"{YEARS} > 0")
    ),
    "bad_rate_by_credit_age_asof": with_needs(
        ["flagged_financials"], by("flagged_financials", AS_OF_YEARS, "Credit_History_Age_Years", f"{AS_OF_YEARS} >= 0")
    ),
    "bad_rate_by_delay_bucket": with_needs(
        ["flagged_financials"],
        by(
            "flagged_financials",
            "case when Delay_from_due_date <= 0 then '0. On Time or Early' when Delay_from_due_date <= 15 then "
            "'1. 1-15 Days Late' when Delay_from_due_date <= 30 then '2. 16-30 Days Late' when Delay_from_due_date <= 60 "
            "then '3. 31-60 Days Late' else '4. > 60 Days Late' end",
            "Delay_Bucket",
            "Delay_from_due_date is not null",
            extra=f", {half_up('sum(Delay_from_due_date)', 'count(*)', 2)} as Avg_Delay_Days",
        ),
    ),
    "bad_rate_by_loan_type": with_needs(
        ["financials", "flags"],
        by(
            f"(select distinct * from ({TYPES.format(where='true')}) where Single_Loan_Type != '') join flags using (Customer_ID)",
            "Single_Loan_Type", "Single_Loan_Type", count_as="Unique_Customers",
        ),
    ),
    "bad_rate_by_single_loan_type": with_needs(
        ["financials", "flags"],
        by(
            f"({TYPES.format(where='Num_of_Loan = 1')}) join flags using (Customer_ID)",
            "Single_Loan_Type", "Single_Loan_Type", "Single_Loan_Type != ''",
        ),
    ),
    "bad_rate_by_mob": with_needs(
        ["loans"],
        "select mob, count(*) as n_rows, cast(sum(case when dpd >= 30 then 1 else 0 end) as bigint) as n_bad, "
        f"{half_up('sum(case when dpd >= 30 then 1 else 0 end)', 'count(*)', 6)} as bad_rate from loans "
        "where loan_start_date < date '2001-01-01' group by mob",
    ),
    "bad_rate_at_final_installment": with_needs(
        ["loans"],
        "select mob, count(*) as n_rows, cast(sum(case when dpd >= 30 then 1 else 0 end) as bigint) as n_bad, "
        f"{half_up('sum(case when dpd >= 30 then 1 else 0 end)', 'count(*)', 6)} as bad_rate from loans "
        "where loan_start_date < date '2001-01-01' and installment_num = 7 group by mob",
    ),
    "value_frequency": _frequency("raw_financials", ["Credit_Mix", "Payment_of_Min_Amount", "Payment_Behaviour"]),
    "attribute_frequency": _frequency("raw_attributes", ["Occupation", "SSN"]),
    "numeric_profile": with_needs(
        ["raw_clickstream"],
        f"""select feature, cast(count(*) filter (value < 0) as bigint) as negative_count, min(value) as min, max(value) as max,
          {half_up("sum(cast(value as bigint)) filter (value >= 0)", "count(*) filter (value >= 0)", 6)} as mean,
          (select v.value from (select value, count(*) as n from l x where x.feature = l.feature and x.value >= 0 group by value) v
            order by n desc, value limit 1) as mode,
          round(quantile_cont(value, 0.5) filter (value >= 0), 6) as median
        from l where value is not null group by feature""",
    ).replace("\nselect feature, cast(count", f",\nl as ({_typed_long('raw_clickstream', CLICKS, 'double')})\nselect feature, cast(count", 1),
    "negative_frequency": with_needs(
        ["raw_clickstream"],
        f"select feature, value as negative_value, count(*) as count, {half_up('100 * count(*)', '(select count(*) from raw_clickstream)', 2)} "
        f"as percentage_overall from ({_typed_long('raw_clickstream', CLICKS, 'double')}) where value < 0 group by feature, value",
    ),
    "malformed_count": with_needs(
        ["raw_attributes"],
        "select count(*) as n_rows, count(*) filter (not regexp_full_match(coalesce(Age, 'None'), '[0-9]+')) as malformed_count, "
        "min(a) as min_age, max(a) as max_age, min(a) filter (a between 10 and 100) as min_plausible_age, "
        "max(a) filter (a between 10 and 100) as max_plausible_age from (select *, try_cast(Age as double) as a from raw_attributes)",
    ),
    "duplicate_keys": with_needs(
        ["raw_loans", "raw_attributes", "raw_financials"],
        union([f"select '{t}' as table_name, ({_duplicates('raw_' + t, 'Customer_ID')}) as duplicates" for t in ("loans", "attributes", "financials")]),
    ),
    "coverage": with_needs(
        ["store"], union([f"select '{c}' as feature, {_covered(c)} as non_null_percent" for c in [*S.ANCHOR_FEATURES, "fe_1"]])
    ),
    "distinct_counts": with_needs(
        ["store"],
        "select count(*) as n_rows, count(distinct loan_id) as n_loans, count(distinct Customer_ID) as n_customers, "
        "count(distinct snapshot_date) as n_months from store",
    ),
    "max_loans_per_customer": with_needs(["store"], f"select {MAX_LOANS} as max_loans_per_customer"),
    "table_preview": with_needs(
        ["loans"], f"select {LOANS_OUT} from loans order by loans.snapshot_date, loan_id, installment_num limit 50"
    ),
    "correlation_rank": with_needs(["flagged_clickstream"], CORRELATION),
    "top_correlations": with_needs(
        ["flagged_clickstream"], f"select * from ({CORRELATION}) order by abs(correlation) desc, feature limit 5"
    ),
    "split_assignment": with_needs(["tagged"], f"select loan_id, {day('snapshot_date')}, label, split from tagged"),
    "split_volume": with_needs(
        ["labels"],
        f"select cast(cast(date_trunc('month', snapshot_date) as date) as varchar) as month, case when snapshot_date between {OOT[0]} and {OOT[1]} then 'OOT' "
        f"when snapshot_date between {FIT[0]} and {FIT[1]} then 'Train/Dev' else 'unused' end as segment, count(*) as n_loans "
        "from labels group by 1, 2",
    ),
    "split_balance": with_needs(
        ["tagged"],
        f"select split, count(*) as n, cast(sum(label) as bigint) as n_bad, {half_up('sum(label)', 'count(*)', 6)} as bad_rate "
        "from tagged group by split",
    ),
    "class_balance": with_needs(
        ["tagged"],
        "select cast(sum(label) as bigint) as positives, cast(sum(1 - label) as bigint) as negatives, "
        f"coalesce({half_up('sum(1 - label)', 'sum(label)', 6)}, 1.0) as pos_weight from tagged where split = 'train'",
    ),
    "customer_overlap": with_needs(
        ["tagged"], union([f"select '{a}_{b}' as pair, {_overlap(a, b)} as shared_customers" for a, b in PAIRS])
    ),
    "fitted_medians": with_needs(
        ["medians"], union([f"select '{c}' as feature, round({c}, 6) as median from medians where {c} is not null" for c in S.NUMERIC_FEATURES])
    ),
    "target_encoding_map": with_needs(["encoding"], "select feature, category, n, round(encoded, 6) as encoded from encoding"),
    "target_encode_apply": with_needs(
        ["matrix"], f"select loan_id, split, {', '.join(f'round({c}, 6) as {c}' for c in S.ENCODED_FEATURES)} from matrix"
    ),
    "median_impute": with_needs(
        ["matrix"], f"select loan_id, split, {', '.join(f'round({c}, 6) as {c}' for c in S.NUMERIC_FEATURES)} from matrix"
    ),
    "standardize": with_needs(["matrix"], f"select feature, round(mean, 6) as mean, round(std, 6) as std from ({SCALES})"),
    "feature_matrix": with_needs(
        ["matrix"],
        "select loan_id, split, label, "
        + ", ".join(
            f"round(({c} - (select mean from s where feature = '{c}')) / (select std from s where feature = '{c}'), 6) as {c}"
            for c in S.FEATURES
        )
        + f" from (select * from matrix), (select 1)",
    ).replace("\nselect loan_id, split, label", f",\ns as ({SCALES})\nselect loan_id, split, label", 1),
    "scored_predictions": with_needs(["predictions"], f"select {PREDICTIONS_OUT} from predictions"),
    "predictions_by_month": with_needs(["predictions"], f"select {PREDICTIONS_OUT} from predictions"),
    "predictions_summary": with_needs(
        ["predictions"],
        f"select count(*) as n, {half_up('sum(model_predict_label)', 'count(*)', 3)} as predicted_bad_rate, "
        f"{half_up('sum(label)', 'count(*)', 3)} as actual_bad_rate from predictions",
    ),
    "baseline_month": monitoring("select cast(b as varchar) as baseline from base"),
    "auc_by_month": monitoring(
        f"select {day('month')}, {half_up('num', 'den', 4)} as auc, {half_up('2 * num - den', 'den', 4)} as gini from auc"
    ),
    "psi_by_month": monitoring(f"select {day('month')}, psi_vs_baseline from psi"),
    "monitoring_table": monitoring(MONTHLY),
    "monitoring_sink": monitoring(MONTHLY),
    "drift_verdict": monitoring(
        f"select {day('month')}, psi_vs_baseline as psi, case when psi_vs_baseline >= 0.25 then 'MAJOR DRIFT -> recommend model refresh' "
        "when psi_vs_baseline >= 0.1 then 'MODERATE DRIFT -> monitor closely' else 'STABLE -> no action needed' end as verdict "
        "from psi order by psi.month desc limit 1"
    ),
    "univariate_auc": with_needs(["matrix"], UNIVARIATE),
    "leakage_audit": with_needs(
        ["store", "tagged", "matrix", "clickstream"],
        f",\nu as (select max(univariate_auc) as m from ({UNIVARIATE}))\n"
        + union(
            [
                _check("repeated_loans", f"({_duplicates('store', 'loan_id')})", 0),
                _check("repeated_click_keys", f"({_duplicates('clickstream', 'Customer_ID, snapshot_date')})", 0),
                _check("max_loans_per_customer", MAX_LOANS, 1),
                *[_check(f"customer_overlap_{a}_{b}", _overlap(a, b), 0) for a, b in PAIRS],
                *[_check(f"anchor_coverage_{c}", _covered(c), 100, ">=") for c in S.ANCHOR_FEATURES],
                _check("suspect_univariate_auc", "(select m from u)", 0.85),
                _check("leaking_univariate_auc", "(select m from u)", 0.95),
            ]
        ),
    ),
    "bronze_roundtrip": with_needs(["raw_financials"], f"select {', '.join(S.FINANCIALS)} from raw_financials"),
    "csv_scan": with_needs(["raw_attributes"], f"select {', '.join(S.ATTRIBUTES)} from raw_attributes"),
    "csv_scan_mixed": with_needs(["raw_attributes"], f"select {', '.join(S.ATTRIBUTES)} from raw_attributes"),
    "backfill_store": with_needs(["store"], f"select {plain(_store_types())} from store"),
    "backfill_monthly": with_needs(["store"], f"select {plain(_store_types())} from store"),
}

LOADED = [
    ("bronze", "loans", "raw_loans"), ("bronze", "attributes", "raw_attributes"), ("bronze", "financials", "raw_financials"),
    ("bronze", "clickstream", "raw_clickstream"), ("silver", "loans", "loans"), ("silver", "attributes", "attributes"),
    ("silver", "financials", "financials"), ("silver", "clickstream", "clickstream"), ("gold", "label_store", "store"),
]
ANSWERS["load_metrics"] = with_needs(
    [relation for _, _, relation in LOADED],
    union([
        f"select '{layer}' as layer, '{table}' as table_name, count(*) as n_rows, "
        "count(*) filter (where Customer_ID is null) as without_customer, "
        "cast(min(cast(snapshot_date as date)) as varchar) as first_month, "
        f"cast(max(cast(snapshot_date as date)) as varchar) as last_month from {relation}"
        for layer, table, relation in LOADED
    ]),
)

for _key, _table, _columns, _where, _n, _places in [
    ("salary", "financials", ["Monthly_Inhand_Salary"], "Monthly_Inhand_Salary > 0", 5, 2),
    ("limit_and_utilisation", "financials", ["Changed_Credit_Limit", "Credit_Utilization_Ratio"],
     "Changed_Credit_Limit is not null and Credit_Utilization_Ratio is not null", 5, 2),
    ("inquiry", "financials", ["Num_Credit_Inquiries"], INQUIRIES, 4, 1),
    ("invested_and_balance", "financials", ["Amount_invested_monthly", "Monthly_Balance"], INQUIRIES, 5, 2),
    ("click", "clickstream", CLICKS, "true", 5, 4),
]:
    _rows = _flagged_long(f"flagged_{_table}", _columns, _where)
    ANSWERS[f"bad_rate_by_{_key}_bucket"] = with_needs([f"flagged_{_table}"], "").rstrip() + buckets(_rows, _n, _places).replace(
        "\nwith v as", ",\nv as", 1
    )

ANSWERS |= {
    "model_scores": with_needs(
        ["labels"],
        f"select loan_id, Customer_ID, {day('snapshot_date')}, label, 'credit_model_2001_01_01' as model_version, "
        "1 as in_range, 1 as class_follows from labels",
    ),
    "model_split_rows": with_needs(
        ["tagged"],
        f"select split, count(*) as n, {half_up('sum(label)', 'count(*)', 3)} as bad_rate, 1 as auc_in_range from tagged group by split",
    ),
    "model_importances": with_needs(["labels"], "select cast(41 as bigint) as n_features, cast(0 as bigint) as n_negative, 1.0 as total from (select count(*) from labels)"),
    "model_reloaded": with_needs(["labels"], "select count(*) as n_loans, cast(0 as bigint) as n_different from labels"),
    "model_monitoring": with_needs(
        ["labels"], "select distinct cast(cast(date_trunc('month', snapshot_date) as date) as varchar) as month, 1 as auc_in_range from labels"
    ),
}
