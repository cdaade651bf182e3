"""The registry: one entry per operator, each over the whole of the tables it is given."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscape import schemas as S
from lendscape.functions import columns as C
from lendscape.functions.dates import month_calendar, month_starts, training_windows
from lendscape.operators import drift, encoding, profiling, rates
from lendscape.operators.ranks import grouped_auc
from lendscape.plans import audit, gold, scoring, silver, training
from lendscape.session import shared_folder, stored, tune
from lendscape.sources import bank, layers, sample

SNAPSHOT = date(2001, 1, 1)
RUN_MONTH = date(2000, 1, 1)
AS_OF = "01-11-2026"
WINDOW = (date(1996, 1, 1), date(2000, 12, 1))
COMPLETED_BEFORE = date(2001, 1, 1)
FINAL_INSTALLMENT = 7

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


class Inputs:
    """The relations of one scale factor, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self.tables = sample.given(spark, sf_dir)

    def raw(self, relation: str) -> DataFrame:
        return sample.raw(self.spark, self.tables, relation)

    @cached_property
    def loans(self) -> DataFrame:
        return silver.clean_loans(self.raw("loans"))

    @cached_property
    def attributes(self) -> DataFrame:
        return silver.clean_attributes(self.raw("attributes"))

    @cached_property
    def financials(self) -> DataFrame:
        return silver.clean_financials(self.raw("financials"))

    @cached_property
    def clickstream(self) -> DataFrame:
        return silver.clean_clickstream(self.raw("clickstream"))

    @cached_property
    def store(self) -> DataFrame:
        return gold.feature_store(self.loans, self.clickstream, self.attributes, self.financials)

    @cached_property
    def windows(self):
        return training_windows(SNAPSHOT)

    @cached_property
    def tagged(self) -> DataFrame:
        return training.with_split(self.store, self.windows)

    @cached_property
    def train_rows(self) -> DataFrame:
        return training.with_categories(self.tagged).filter("split = 'train'")

    def flagged(self, table: DataFrame, *columns: str, counted: bool = True) -> DataFrame:
        return rates.with_default_flag(table.select("Customer_ID", *columns), rates.latest_default_flag(self.loans), counted)

    @cached_property
    def predictions(self) -> DataFrame:
        """Scores by rule instead of by model, so that every engine has the same ones."""
        months = (F.year("snapshot_date") - 1995) * 12 + F.month("snapshot_date") - 1
        points = F.col("loan_id").cast("bigint") * 7919 % 700 + F.col("label") * 200 + months
        scored = gold.labels(self.loans).withColumn("model_predict_proba", points / F.lit(1000.0))
        return scoring.with_class(scored, self.windows.version)

    @cached_property
    def fitted(self) -> tuple[DataFrame, encoding.Fitted]:
        """Stored training rows and what preprocessing learnt from them. Months outside the windows are not built for it."""
        self.tagged = stored(self.tagged, "tagged")
        columns = ["loan_id", "label", *S.NUMERIC_FEATURES, *S.CATEGORIES]
        rows = stored(self.train_rows.select(*columns), "train-rows")
        return rows, encoding.fit(rows)

    @cached_property
    def months(self) -> list[date]:
        """Every month from the first to the last of any raw relation."""
        day = F.col("snapshot_date").try_cast("date")
        spans = [self.raw(t).agg(F.min(day).alias("low"), F.max(day).alias("high")) for t in S.TABLES]
        low, high = layers.append_months(spans).agg(F.min("low"), F.max("high")).first()
        return month_starts(low, high) if low else []

    def workspace(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """Types every engine compares alike: dates as text, floats as doubles, lists joined."""

    def column(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.FloatType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c, "|").alias(f.name)
        return c

    return df.select([column(f) for f in df.schema.fields])


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(Inputs(spark, sf_dir)))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


# Layers


@query
def snapshot_ingest(i: Inputs) -> DataFrame:
    """All months of the loan book, selected in one pass."""
    return layers.of_months(i.raw("loans"), i.months)


@query
def month_calendar_rows(i: Inputs) -> DataFrame:
    return month_calendar(i.spark, F.min("snapshot_date"), F.max("snapshot_date"), i.loans)


@query
def window_load(i: Inputs) -> DataFrame:
    """Rows per month of each silver table inside an inclusive window."""
    parts = []
    for name in S.TABLES:
        inside = getattr(i, name).filter(layers.in_window(*WINDOW))
        parts.append(inside.groupBy("snapshot_date").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")))
    return layers.append_months(parts)


@query
def loans_dpd(i: Inputs) -> DataFrame:
    return i.loans


@query
def clean_attributes(i: Inputs) -> DataFrame:
    return i.attributes


@query
def clean_financials(i: Inputs) -> DataFrame:
    return i.financials


@query
def clean_clickstream(i: Inputs) -> DataFrame:
    """As run for one month: nothing logged later gets through."""
    return silver.clean_clickstream(i.raw("clickstream"), RUN_MONTH)


@query
def loan_type_array(i: Inputs) -> DataFrame:
    return i.financials.select(
        "Customer_ID", "snapshot_date", "Type_of_Loan", F.coalesce(F.array_size("Type_of_Loan"), F.lit(0)).alias("n_types"),
        "Num_of_Loan",
    )


# Labels and features


@query
def default_labels(i: Inputs) -> DataFrame:
    return gold.labels(i.loans)


@query
def application_rows(i: Inputs) -> DataFrame:
    return gold.application_rows(i.loans)


@query
def bad_rate_by_app_month(i: Inputs) -> DataFrame:
    labelled = gold.labels(i.loans).withColumnRenamed("label", "isDefault")
    return rates.bad_rate_by(labelled, "snapshot_date", count_as="n_loans").orderBy("snapshot_date")


@query
def feature_ratios(i: Inputs) -> DataFrame:
    return gold.financial_features(i.financials).select(
        "Customer_ID", "snapshot_date", "Debt_to_Income_Ratio", "EMI_to_Salary_Ratio", "Savings_Propensity"
    )


@query
def risk_indices(i: Inputs) -> DataFrame:
    demographic = gold.demographic_features(i.attributes).select(*silver.KEY, "Occupation_Idx", "Is_Age_gt_45")
    financial = gold.financial_features(i.financials)
    return financial.select(*silver.KEY, "Spend_Level_Idx", "Payment_Value_Level_Idx").join(demographic, silver.KEY)


@query
def credit_history_age(i: Inputs) -> DataFrame:
    return gold.financial_features(i.financials).select(
        *silver.KEY, "Credit_History_Age", "Credit_History_Age_Months", "Credit_History_Age_Years", "is_Credit_Age_gt_15"
    )


def _history_as_of(rows: DataFrame) -> DataFrame:
    elapsed = F.months_between(F.to_date(F.lit(AS_OF), "dd-MM-yyyy"), "snapshot_date")
    months = C.history_months(F.col("Credit_History_Age")) + elapsed
    return rows.withColumns(
        {"Credit_History_Age_Months": F.round(months, 2), "Credit_History_Age_Years": C.whole_years(months)}
    )


@query
def credit_history_asof(i: Inputs) -> DataFrame:
    return _history_as_of(i.financials.select(*silver.KEY, "Credit_History_Age"))


@query
def derived_categoricals(i: Inputs) -> DataFrame:
    return training.with_categories(i.store).select("loan_id", *S.CATEGORIES)


@query
def gold_feature_store(i: Inputs) -> DataFrame:
    return i.store


# Default rates


@query
def latest_default_label(i: Inputs) -> DataFrame:
    return rates.latest_default_flag(i.loans)


def _counted(name: str, column: str) -> None:
    def run(i: Inputs) -> DataFrame:
        known = i.flagged(i.financials, column).filter(F.col(column) >= 0)
        return rates.bad_rate_by(known, column).orderBy(column)

    run.__name__ = f"bad_rate_by_{name}"
    query(run)


for _name, _column in {
    "num_loans": "Num_of_Loan",
    "bank_accounts": "Num_Bank_Accounts",
    "credit_cards": "Num_Credit_Card",
}.items():
    _counted(_name, _column)


@query
def bad_rate_by_age(i: Inputs) -> DataFrame:
    plausible = i.flagged(i.attributes, "Age").filter((F.col("Age") > 0) & (F.col("Age") < 100))
    return rates.bad_rate_by(plausible, "Age").orderBy("Age")


@query
def bad_rate_by_occupation(i: Inputs) -> DataFrame:
    named = i.flagged(i.attributes, "Occupation").withColumn("Occupation_Clean", C.or_unknown(F.col("Occupation")))
    return rates.bad_rate_by(named, "Occupation_Clean").orderBy(F.desc("Default_Rate_Percent"), "Occupation_Clean")


@query
def bad_rate_by_payment_behaviour(i: Inputs) -> DataFrame:
    behaviour = C.or_unknown(C.blank_placeholder("Payment_Behaviour"))
    named = i.flagged(i.financials, "Payment_Behaviour").withColumn("Payment_Behaviour_Clean", behaviour)
    return rates.bad_rate_by(named, "Payment_Behaviour_Clean").orderBy(
        F.desc("Default_Rate_Percent"), "Payment_Behaviour_Clean"
    )


@query
def bad_rate_by_spend_level(i: Inputs) -> DataFrame:
    named = i.flagged(i.financials, "Payment_Behaviour").withColumn("Spend_Level", C.spend_level("UNKNOWN"))
    return rates.bad_rate_by(named, "Spend_Level").orderBy("Spend_Level")


@query
def bad_rate_by_payment_value(i: Inputs) -> DataFrame:
    named = i.flagged(i.financials, "Payment_Behaviour").withColumn("Payment_Value", C.payment_value("UNKNOWN"))
    return rates.bad_rate_by(named, "Payment_Value").orderBy("Payment_Value")


@query
def bad_rate_by_credit_age(i: Inputs) -> DataFrame:
    years = C.whole_years(C.history_months(F.col("Credit_History_Age")))
    aged = i.flagged(i.financials, "Credit_History_Age").withColumn("Credit_History_Age_Years", years)
    known = aged.filter("Credit_History_Age_Years > 0")
    return rates.bad_rate_by(known, "Credit_History_Age_Years").orderBy("Credit_History_Age_Years")


@query
def bad_rate_by_credit_age_asof(i: Inputs) -> DataFrame:
    aged = _history_as_of(i.flagged(i.financials, "snapshot_date", "Credit_History_Age"))
    known = aged.filter("Credit_History_Age_Years >= 0")
    return rates.bad_rate_by(known, "Credit_History_Age_Years").orderBy("Credit_History_Age_Years")


@query
def bad_rate_by_delay_bucket(i: Inputs) -> DataFrame:
    days = F.col("Delay_from_due_date")
    known = i.flagged(i.financials, "Delay_from_due_date").filter(days.isNotNull())
    banded = known.withColumn("Delay_Bucket", C.delay_band(days))
    return rates.bad_rate_by(banded, "Delay_Bucket", Avg_Delay_Days=(days, 2)).orderBy("Delay_Bucket")


@query
def bad_rate_by_salary_bucket(i: Inputs) -> DataFrame:
    paid = i.flagged(i.financials, "Monthly_Inhand_Salary").filter("Monthly_Inhand_Salary > 0")
    return rates.bad_rate_by_bucket(paid, ["Monthly_Inhand_Salary"])


@query
def bad_rate_by_limit_and_utilisation_bucket(i: Inputs) -> DataFrame:
    columns = ["Changed_Credit_Limit", "Credit_Utilization_Ratio"]
    return rates.bad_rate_by_bucket(i.flagged(i.financials, *columns).dropna(subset=columns), columns)


def _with_inquiries(i: Inputs) -> DataFrame:
    columns = ["Num_Credit_Inquiries", "Amount_invested_monthly", "Monthly_Balance"]
    known = i.flagged(i.financials, *columns)
    return known.filter("Num_Credit_Inquiries >= 0 and Amount_invested_monthly >= 0 and Monthly_Balance is not null")


@query
def bad_rate_by_inquiry_bucket(i: Inputs) -> DataFrame:
    return rates.bad_rate_by_bucket(_with_inquiries(i), ["Num_Credit_Inquiries"], buckets=4, places=1)


@query
def bad_rate_by_invested_and_balance_bucket(i: Inputs) -> DataFrame:
    return rates.bad_rate_by_bucket(_with_inquiries(i), ["Amount_invested_monthly", "Monthly_Balance"])


@query
def bad_rate_by_click_bucket(i: Inputs) -> DataFrame:
    clicks = i.flagged(i.clickstream, *S.CLICK_FEATURES)
    return rates.bad_rate_by_bucket(clicks, S.CLICK_FEATURES, places=4)


@query
def bad_rate_by_loan_type(i: Inputs) -> DataFrame:
    listed = rates.listed_loan_types(i.financials, once_per_customer=True)
    by_type = rates.bad_rate_by(i.flagged(listed, "Single_Loan_Type"), "Single_Loan_Type", count_as="Unique_Customers")
    return by_type.orderBy(F.desc("Default_Rate_Percent"), "Single_Loan_Type")


@query
def bad_rate_by_single_loan_type(i: Inputs) -> DataFrame:
    single = i.financials.filter("Num_of_Loan = 1")
    listed = rates.listed_loan_types(single, once_per_customer=False)
    by_type = rates.bad_rate_by(i.flagged(listed, "Single_Loan_Type"), "Single_Loan_Type")
    return by_type.orderBy(F.desc("Default_Rate_Percent"), "Single_Loan_Type")


@query
def bad_rate_by_mob(i: Inputs) -> DataFrame:
    completed = i.loans.filter(F.col("loan_start_date") < F.lit(COMPLETED_BEFORE))
    return rates.bad_rate_by_month_on_book(completed).orderBy("mob")


@query
def bad_rate_at_final_installment(i: Inputs) -> DataFrame:
    final = i.loans.filter((F.col("loan_start_date") < F.lit(COMPLETED_BEFORE)) & (F.col("installment_num") == FINAL_INSTALLMENT))
    return rates.bad_rate_by_month_on_book(final)


# Profiles


@query
def value_frequency(i: Inputs) -> DataFrame:
    columns = ["Credit_Mix", "Payment_of_Min_Amount", "Payment_Behaviour"]
    return profiling.value_frequency(i.raw("financials"), columns)


@query
def attribute_frequency(i: Inputs) -> DataFrame:
    return profiling.value_frequency(i.raw("attributes"), ["Occupation", "SSN"])


@query
def numeric_profile(i: Inputs) -> DataFrame:
    return profiling.numeric_profile(i.raw("clickstream"), S.CLICK_FEATURES)


@query
def negative_frequency(i: Inputs) -> DataFrame:
    return profiling.negative_frequency(i.raw("clickstream"), S.CLICK_FEATURES)


@query
def malformed_count(i: Inputs) -> DataFrame:
    return profiling.age_text_profile(i.raw("attributes"))


@query
def duplicate_keys(i: Inputs) -> DataFrame:
    parts = [
        profiling.duplicate_keys(i.raw(t), "Customer_ID").withColumn("table_name", F.lit(t))
        for t in ("loans", "attributes", "financials")
    ]
    return layers.append_months(parts)


@query
def coverage(i: Inputs) -> DataFrame:
    return profiling.coverage(i.store, [*S.ANCHOR_FEATURES, "fe_1"])


@query
def distinct_counts(i: Inputs) -> DataFrame:
    return profiling.store_counts(i.store)


@query
def max_loans_per_customer(i: Inputs) -> DataFrame:
    return profiling.max_loans_per_customer(i.store)


@query
def table_preview(i: Inputs) -> DataFrame:
    """The first 50 rows of the silver loans, as shown when inspecting a table."""
    return profiling.preview(i.loans, ["snapshot_date", "loan_id", "installment_num"])


def _correlations(i: Inputs) -> DataFrame:
    return rates.rank_by_correlation(i.flagged(i.clickstream, *S.CLICK_FEATURES, counted=False), S.CLICK_FEATURES)


def _rounded(ranking: DataFrame) -> DataFrame:
    return ranking.select("feature", F.round("correlation", 6).alias("correlation"))


@query
def correlation_rank(i: Inputs) -> DataFrame:
    return _rounded(_correlations(i).orderBy(F.desc("strength"), "feature"))


@query
def top_correlations(i: Inputs) -> DataFrame:
    return _rounded(rates.top_correlations(_correlations(i), 5))


# Splits and fitted statistics


@query
def split_assignment(i: Inputs) -> DataFrame:
    return i.tagged.select("loan_id", "snapshot_date", "label", "split")


@query
def split_volume(i: Inputs) -> DataFrame:
    month = F.trunc("snapshot_date", "MM").alias("month")
    segment = i.windows.segment(F.col("snapshot_date")).alias("segment")
    return gold.labels(i.loans).groupBy(month, segment).agg(F.count("*").alias("n_loans")).orderBy("month")


@query
def split_balance(i: Inputs) -> DataFrame:
    return training.split_balance(i.tagged)


@query
def class_balance(i: Inputs) -> DataFrame:
    balance = training.class_balance(i.train_rows)
    return balance.withColumn("pos_weight", F.round("pos_weight", 6))


@query
def customer_overlap(i: Inputs) -> DataFrame:
    return audit.customer_overlap(i.tagged)


@query
def fitted_medians(i: Inputs) -> DataFrame:
    rows = stored(i.train_rows.select(*S.NUMERIC_FEATURES), "train-rows")
    return encoding.medians(rows).select("feature", F.round("median", 6).alias("median"))


@query
def target_encoding_map(i: Inputs) -> DataFrame:
    rows = stored(i.train_rows.select("label", *S.CATEGORIES), "train-rows")
    return encoding.target_encoding(rows).withColumn("encoded", F.round("encoded", 6))


@query
def target_encode_apply(i: Inputs) -> DataFrame:
    """Encode all rows of all splits with the map of the training split."""
    _, fitted = i.fitted
    rows = training.with_categories(i.tagged).select("loan_id", "split", *S.CATEGORIES)
    encoded = encoding.apply_encoding(rows, fitted.encoding, F.lit(fitted.overall))
    return encoded.select("loan_id", "split", *[F.round(c, 6).alias(c) for c in S.ENCODED_FEATURES])


@query
def median_impute(i: Inputs) -> DataFrame:
    _, fitted = i.fitted
    rows = training.with_categories(i.tagged)
    filled = encoding.impute(rows, fitted.medians, ["loan_id", "split"])
    return filled.select("loan_id", "split", *[F.round(c, 6).alias(c) for c in S.NUMERIC_FEATURES])


@query
def standardize(i: Inputs) -> DataFrame:
    rows, fitted = i.fitted
    scales = encoding.scales(fitted.encoded(rows, []))
    return scales.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def feature_matrix(i: Inputs) -> DataFrame:
    """The model's inputs for every row of every split, in training order."""
    _, fitted = i.fitted
    matrix = fitted.transform(training.with_categories(i.tagged), ["loan_id", "split", "label"])
    return matrix.select("loan_id", "split", "label", *[F.round(c, 6).alias(c) for c in S.FEATURES])


# Monitoring and audit


@query
def scored_predictions(i: Inputs) -> DataFrame:
    return i.predictions


@query
def predictions_summary(i: Inputs) -> DataFrame:
    return scoring.summary(i.predictions)


@query
def baseline_month(i: Inputs) -> DataFrame:
    return drift.baseline_month(drift.score_histogram(i.predictions))


@query
def auc_by_month(i: Inputs) -> DataFrame:
    auc = grouped_auc(drift.score_histogram(i.predictions), ["month"], "score")
    return auc.select("month", F.round("auc", 4).alias("auc"), F.round("gini", 4).alias("gini"))


@query
def psi_by_month(i: Inputs) -> DataFrame:
    return drift.monthly_metrics(i.predictions).select("month", "psi_vs_baseline")


@query
def monitoring_table(i: Inputs) -> DataFrame:
    return drift.monthly_metrics(i.predictions).orderBy("month")


@query
def drift_verdict(i: Inputs) -> DataFrame:
    return drift.drift_verdict(drift.monthly_metrics(i.predictions))


@query
def univariate_auc(i: Inputs) -> DataFrame:
    rows, fitted = i.fitted
    return audit.univariate_auc(fitted.transform(rows, ["label"])).orderBy("univariate_auc", "feature")


@query
def leakage_audit(i: Inputs) -> DataFrame:
    i.store = stored(i.store, "store")  # most checks read it
    rows, fitted = i.fitted
    return audit.leakage_audit(i.store, i.tagged, fitted.transform(rows, ["label"]), i.clickstream)


# Sinks: write, read back


@query
def bronze_roundtrip(i: Inputs) -> DataFrame:
    """Land all months of a source by month and read them back."""
    root = i.workspace("bronze")
    layers.land_bronze(i.raw("financials"), root, "financials", i.months)
    return layers.read_table(i.spark, root, "bronze", "financials").select(*S.FINANCIALS)


@query
def csv_scan(i: Inputs) -> DataFrame:
    """Write a raw source as CSV and scan it back as text."""
    path = i.workspace("csv")
    i.raw("attributes").write.option("header", True).csv(path)
    return layers.read_raw(i.spark, path, "attributes")


@query
def csv_scan_mixed(i: Inputs) -> DataFrame:
    """The same from one folder whose files have their columns in different orders, with a stranger among them."""
    path, rows = i.workspace("csv"), i.raw("attributes")
    late = F.crc32(F.col("Customer_ID").cast("binary")) % 2 == 0
    rows.filter(~F.coalesce(late, F.lit(False))).write.option("header", True).csv(path)
    mixed = rows.filter(late).withColumn("unknown", F.lit("x")).select("unknown", *reversed(rows.columns))
    mixed.write.mode("append").option("header", True).csv(path)
    return layers.read_raw(i.spark, path, "attributes")


@query
def backfill_store(i: Inputs) -> DataFrame:
    """Bronze, silver and gold for all months through files, then the store read back."""
    root = i.workspace("backfill")
    layers.run_backfill(i.spark, {t: i.raw(t) for t in S.TABLES}, root, i.months)
    return layers.read_table(i.spark, root, "gold", "label_store").select(*S.STORE_COLUMNS)


@query
def backfill_monthly(i: Inputs) -> DataFrame:
    """The same store grown in runs: a first span without a fifth of its loans, the spans in order, the first again whole."""
    root, raw = i.workspace("monthly"), {t: i.raw(t) for t in S.TABLES}
    third = -(-len(i.months) // 3) or 1
    spans = [i.months[k : k + third] for k in range(0, len(i.months), third)]
    withheld = F.coalesce(F.crc32(F.col("loan_id").cast("binary")) % 5 == 0, F.lit(False))
    short = {**raw, "loans": raw["loans"].filter(~withheld)}
    layers.run_backfill(i.spark, short, root, spans[0])
    for span in [*spans[1:], spans[0]]:
        layers.run_backfill(i.spark, raw, root, span)
    return layers.read_table(i.spark, root, "gold", "label_store").select(*S.STORE_COLUMNS)


@query
def load_metrics(i: Inputs) -> DataFrame:
    """What a backfill observed of each of its nine writes."""
    root = i.workspace("metrics")
    layers.run_backfill(i.spark, {t: i.raw(t) for t in S.TABLES}, root, i.months)
    return layers.load_metrics(i.spark, root).select(
        "layer", F.col("table").alias("table_name"), F.col("rows").alias("n_rows"), "without_customer", "first_month", "last_month"
    )


@query
def predictions_by_month(i: Inputs) -> DataFrame:
    root = i.workspace("predictions")
    scoring.write_predictions(i.predictions, root)
    return layers.read_table(i.spark, root, "gold", "model_predictions").select(*i.predictions.columns)


@query
def monitoring_sink(i: Inputs) -> DataFrame:
    root = i.workspace("monitoring")
    scoring.write_predictions(i.predictions, root)
    return scoring.write_monitoring(i.spark, root)


# Models: no SQL counterpart

_TRAINED: dict[tuple[str, str], tuple[DataFrame, training.Trained]] = {}


def _trained(i: Inputs) -> tuple[DataFrame, training.Trained]:
    """One fixed-parameter model per session and scale factor, shared by the queries below."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _TRAINED:
        store = stored(i.store, "store")
        _TRAINED[key] = store, training.train(store, i.windows)
    return _TRAINED[key]


def train_fixed_rows(i: Inputs) -> DataFrame:
    _, trained = _trained(i)
    weights = trained.model.featureImportances.toArray()
    return i.spark.createDataFrame(
        [(f, float(w)) for f, w in zip(S.FEATURES, weights, strict=True)], "feature string, importance double"
    )


@query
def train_fixed(i: Inputs) -> DataFrame:
    """Importance of each feature in the fixed-parameter model."""
    return train_fixed_rows(i)


@query
def train_search(i: Inputs) -> DataFrame:
    """Cross-validated AUC of each draw, over all training rows."""
    trained = training.train(i.store, i.windows, tune=True)
    return i.spark.createDataFrame(
        [{**{k: float(v) for k, v in t.items()}} for t in trained.trials],
        ", ".join(f"{k} double" for k in [*training.SEARCH_GRID, "mean_auc"]),
    )


@query
def score_batch(i: Inputs) -> DataFrame:
    store, trained = _trained(i)
    return scoring.predictions(store, trained)


@query
def split_evaluation(i: Inputs) -> DataFrame:
    store, trained = _trained(i)
    return training.evaluate(trained, store)


@query
def artefact_roundtrip(i: Inputs) -> DataFrame:
    """Save the model, load the latest from the bank, score with it."""
    store, trained = _trained(i)
    path = i.workspace("bank")
    bank.save(i.spark, trained, path, training.evaluate(trained, store))
    return scoring.predictions(store, bank.load(i.spark, path))


# Models: what SQL can state about them


@query
def model_scores(i: Inputs) -> DataFrame:
    """Every loan is scored once; probabilities are ones, and the class follows them."""
    store, trained = _trained(i)
    p = F.col("model_predict_proba")
    follows = F.col("model_predict_label") == (p >= scoring.THRESHOLD).cast("int")
    return scoring.predictions(store, trained).select(
        "loan_id", "Customer_ID", "snapshot_date", "label", "model_version",
        p.between(0, 1).cast("int").alias("in_range"), follows.cast("int").alias("class_follows"),
    )


@query
def model_split_rows(i: Inputs) -> DataFrame:
    """Rows and bad rate of each split the model is evaluated on."""
    store, trained = _trained(i)
    in_range = F.col("auc").between(0, 1).cast("int").alias("auc_in_range")
    return training.evaluate(trained, store).select("split", "n", "bad_rate", in_range)


@query
def model_importances(i: Inputs) -> DataFrame:
    """The importances are shares of all model inputs."""
    weights = train_fixed_rows(i)
    return weights.agg(
        F.count("*").alias("n_features"), F.count_if(F.col("importance") < 0).alias("n_negative"),
        F.round(F.sum("importance"), 6).alias("total"),
    )


@query
def model_reloaded(i: Inputs) -> DataFrame:
    """Loans whose score differs once the model has been saved, loaded, saved and loaded again."""
    store, trained = _trained(i)
    path = i.workspace("bank")
    bank.save(i.spark, trained, path)
    bank.save(i.spark, bank.load(i.spark, path), path)
    score = F.col("model_predict_proba")
    before = scoring.predictions(store, trained).select("loan_id", score.alias("before"))
    after = scoring.predictions(store, bank.load(i.spark, path)).select("loan_id", score.alias("after"))
    both = before.join(after, "loan_id", "full")
    return both.agg(F.count("*").alias("n_loans"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_different"))


@query
def model_monitoring(i: Inputs) -> DataFrame:
    """Store, model scores, predictions table, monitoring table: months as read back from its CSV half."""
    store, trained = _trained(i)
    root = i.workspace("monitored")
    scoring.write_predictions(scoring.predictions(store, trained), root)
    scoring.write_monitoring(i.spark, root)
    written = i.spark.read.option("header", True).csv(f"{layers.path_of(root, 'gold', 'model_monitoring')}/csv")
    auc = F.col("auc").try_cast("double")
    return written.select(F.col("month").try_cast("date").alias("month"), (auc.isNull() | auc.between(0, 1)).cast("int").alias("auc_in_range"))
