"""Landing, backfill and the model bank, through files."""

import gzip
import random
import time
from datetime import date

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from contract import queries as Q
from lendscape import schemas as S
from lendscape import session
from lendscape.functions.dates import month_starts, training_windows
from lendscape.plans import audit, gold, scoring, silver, training
from lendscape.sources import bank, layers, published, sample

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """The sample relations as CSV files, the way a feed delivers them."""
    root = tmp_path_factory.mktemp("raw")
    for table in S.TABLES:
        sample.raw(spark, sample.given(spark, SF), table).coalesce(1).write.option("header", True).csv(f"{root}/{table}")
    return {t: layers.read_raw(spark, f"{root}/{t}", t) for t in S.TABLES}


@pytest.fixture(scope="module")
def backfilled(spark, raw, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layers"))
    return root, layers.run_backfill(spark, raw, root, Q.Inputs(spark, SF).months)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_backfill_counts_what_it_writes(spark, raw, backfilled):
    root, counted = backfilled
    assert counted["bronze.loans"] == raw["loans"].count()
    assert counted["silver.attributes"] == layers.read_table(spark, root, "silver", "attributes").count()
    store = layers.read_table(spark, root, "gold", "label_store")
    assert counted["gold.label_store"] == store.count() == store.select("loan_id").distinct().count()


def test_backfill_through_files_equals_the_plan_without(spark, backfilled):
    root, _ = backfilled
    stored = layers.read_table(spark, root, "gold", "label_store").select(*S.STORE_COLUMNS)
    assert rows(stored) == rows(Q.Inputs(spark, SF).store)


def test_rerunning_months_changes_nothing(spark, raw, backfilled):
    root, _ = backfilled
    before = {t: rows(layers.read_table(spark, root, "silver", t)) for t in S.TABLES}
    store = rows(layers.read_table(spark, root, "gold", "label_store"))
    layers.run_backfill(spark, raw, root, month_starts(date(1998, 1, 1), date(1998, 3, 1)))
    assert {t: rows(layers.read_table(spark, root, "silver", t)) for t in S.TABLES} == before
    assert rows(layers.read_table(spark, root, "gold", "label_store")) == store


def test_month_by_month_equals_all_at_once(spark, raw, backfilled, tmp_path):
    root, _ = backfilled
    for m in month_starts(date(1995, 1, 1), date(1995, 9, 1)):
        layers.run_backfill(spark, raw, str(tmp_path), [m])
    grown = layers.read_table(spark, str(tmp_path), "gold", "label_store")
    whole = layers.read_table(spark, root, "gold", "label_store").filter(layers.in_window(date(1995, 1, 1), date(1995, 3, 1)))
    assert rows(grown) == rows(whole)


LOAN = "loan_id, Customer_ID, loan_start_date, tenure, installment_num, loan_amt, due_amt, paid_amt, overdue_amt, balance, snapshot_date"


def loan_rows(spark, book):
    """(loan, month on book, snapshot, overdue) as raw text rows of the loan book."""
    data = [(f"L{n}", f"C{n}", "2023-01-01", "10", str(k), "1000", "100", "100", str(late), "0", f"{day}") for n, k, day, late in book]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in LOAN.split(", ")))


def test_late_and_withdrawn_loans_month_by_month(spark, tmp_path):
    months = month_starts(date(2023, 1, 1), date(2023, 9, 1))
    book = [(n, k, months[k], 0) for n in (1, 2) for k in range(7)]
    book += [(3, k, months[k], 0) for k in range(6)] + [(3, 6, months[7], 0)]  # month 6 comes a month late
    book += [(4, k, months[k], 0) for k in (0, 1, 2, 4, 5, 6)] + [(4, 3, months[8], 900)]  # a missed month comes after it
    others = {t: spark.createDataFrame([], S.raw_schema(t)) for t in S.TABLES if t != "loans"}
    raw = {**others, "loans": loan_rows(spark, book)}
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    counts = [layers.run_backfill(spark, raw, grown, [m])["gold.label_store"] for m in months]
    assert counts[:6] == [0] * 6 and counts[6] == 3
    layers.run_backfill(spark, raw, whole, months)
    store = layers.read_table(spark, grown, "gold", "label_store")
    assert rows(store) == rows(layers.read_table(spark, whole, "gold", "label_store"))
    assert {r.loan_id: r.label for r in store.collect()} == {"L1": 0, "L2": 0, "L3": 0, "L4": 1}
    gone = {**others, "loans": raw["loans"].filter("loan_id not in ('L1', 'L2', 'L4')")}
    layers.run_backfill(spark, gone, grown, months)
    assert [r.loan_id for r in layers.read_table(spark, grown, "gold", "label_store").collect()] == ["L3"]
    layers.run_backfill(spark, {**others, "loans": raw["loans"].limit(0)}, grown, months)
    assert layers.rows_of(spark, f"{grown}/gold/label_store", months) == 0


def others_of(spark):
    return {t: spark.createDataFrame([], S.raw_schema(t)) for t in S.TABLES if t != "loans"}


def labelled(spark, root):
    return {(r.loan_id, str(r.snapshot_date)[:7], r.label) for r in layers.read_table(spark, root, "gold", "label_store").collect()}


def test_a_month_landed_again_takes_back_what_it_held(spark, tmp_path):
    """Rows that a second landing of one month lacks, adds or changes reach the labels by a run of that month alone."""
    months = month_starts(date(2023, 1, 1), date(2023, 9, 1))
    book = [(1, k, months[k], 0) for k in range(7)] + [(2, k, months[k + 1], 0) for k in range(7)]
    book += [(3, k, months[k], 0) for k in range(6)] + [(3, 6, months[8], 0)]  # completed two months late
    root, others = str(tmp_path), others_of(spark)
    layers.run_backfill(spark, {**others, "loans": loan_rows(spark, book)}, root, months)
    assert labelled(spark, root) == {("L1", "2023-01", 0), ("L2", "2023-02", 0), ("L3", "2023-01", 0)}

    def rerun(book, month):
        layers.run_backfill(spark, {**others, "loans": loan_rows(spark, book)}, root, [month])
        return labelled(spark, root)

    late = [b for b in book if b != (3, 6, months[8], 0)]
    assert rerun([*late, (9, 3, months[8], 0)], months[8]) == {("L1", "2023-01", 0), ("L2", "2023-02", 0)}
    assert rerun(book, months[8]) == {("L1", "2023-01", 0), ("L2", "2023-02", 0), ("L3", "2023-01", 0)}
    bad = [(n, k, m, 900 if (n, k) == (1, 4) else late) for n, k, m, late in book]
    assert rerun(bad, months[4]) == {("L1", "2023-01", 1), ("L2", "2023-02", 0), ("L3", "2023-01", 0)}
    no_start = [b for b in bad if b[:2] != (1, 0)]
    assert rerun(no_start, months[0]) == {("L2", "2023-02", 0), ("L3", "2023-01", 0)}
    earlier = [*bad, (2, 0, months[0], 0)]  # a second month 0, before the known one
    assert rerun(earlier, months[0]) == {("L1", "2023-01", 1), ("L2", "2023-01", 0), ("L3", "2023-01", 0)}
    whole = str(tmp_path / "whole")
    layers.run_backfill(spark, {**others, "loans": loan_rows(spark, earlier)}, whole, months)
    assert labelled(spark, whole) == labelled(spark, root)


def test_a_monthly_run_reads_changed_months_of_silver_loans_only(spark, tmp_path, monkeypatch):
    months = month_starts(date(2023, 1, 1), date(2023, 8, 1))
    book = [(n, k, months[n + k], 0) for n in (0, 1) for k in range(7)]
    root, others = str(tmp_path), others_of(spark)
    raw = {**others, "loans": loan_rows(spark, book)}
    layers.run_backfill(spark, raw, root, months[:7])
    read, real = [], layers.gold.loan_months
    monkeypatch.setattr(layers.gold, "loan_months", lambda loans, mob: read.append(loans.inputFiles()) or real(loans, mob))
    wide, plans = layers.gold.with_features, []
    monkeypatch.setattr(layers.gold, "with_features", lambda *frames: plans.append(wide(*frames)) or plans[-1])
    layers.run_backfill(spark, raw, root, [months[7]])
    assert len(read) == 1 and read[0] and all(f"{months[7]}" in f and "/silver/loans/" in f for f in read[0])
    assert not any("/silver/loans/" in f for f in plans[0].inputFiles())
    assert labelled(spark, root) == {("L0", "2023-01", 0), ("L1", "2023-02", 0)}
    assert layers.advance_state(spark, root) == []


def test_a_run_that_breaks_off_before_gold_is_made_up_for(spark, tmp_path, monkeypatch):
    months = month_starts(date(2023, 1, 1), date(2023, 9, 1))
    book = [(1, k, months[k], 0) for k in range(6)] + [(1, 6, months[8], 0)]
    root, others = str(tmp_path), others_of(spark)
    raw = {**others, "loans": loan_rows(spark, book)}
    layers.run_backfill(spark, raw, root, months[:8])

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(layers.gold, "with_features", broken)
        layers.run_backfill(spark, raw, root, [months[8]])
    assert labelled(spark, root) == set()
    layers.run_backfill(spark, {**others, "loans": raw["loans"].limit(0)}, root, [date(2023, 12, 1)])
    assert labelled(spark, root) == {("L1", "2023-01", 0)}


def monthly(spark, first, second, name="v"):
    rows = [(f"C{k}", first, date(2023, 1, 1)) for k in range(3)] + [(f"C{k}", second, date(2023, 2, 1)) for k in range(2)]
    return spark.createDataFrame(rows, f"Customer_ID string, {name} int, snapshot_date date")


def held(spark, path):
    return sorted({(r.v, str(r.snapshot_date)[:7]) for r in published.read(spark, path).collect()})


def test_a_failed_load_leaves_the_old_months(spark, tmp_path):
    path, months = str(tmp_path / "t"), [date(2023, 1, 1), date(2023, 2, 1)]
    assert published.read(spark, path) is None and published.manifest(spark, path) is None
    published.write(monthly(spark, 1, 1), path, months)
    failing = monthly(spark, 2, 2).withColumn("v", F.when(F.col("snapshot_date") == "2023-02-01", F.raise_error(F.lit("x"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="x"):
        published.write(failing, path, months)
    with pytest.raises(ValueError, match="v of .* is int, not string"):
        published.write(monthly(spark, 2, 2).withColumn("v", F.col("v").cast("string")), path, months)
    plain = str(tmp_path / "plain")
    monthly(spark, 1, 1).write.partitionBy("snapshot_date").parquet(plain)
    with pytest.raises(FileExistsError, match="no manifest names"):
        published.write(monthly(spark, 2, 2), plain)
    assert held(spark, path) == [(1, "2023-01"), (1, "2023-02")]
    assert sum(n.startswith("_load=") for n in published._Files(spark, path).names()) == 1


def test_readers_who_have_begun_and_other_writers(spark, tmp_path):
    path, jan = str(tmp_path / "t"), [date(2023, 1, 1)]
    published.write(monthly(spark, 1, 1), path)
    begun = published.read(spark, path)
    published.write(monthly(spark, 2, 2).filter("snapshot_date = '2023-01-01'"), path, jan)
    assert held(spark, path) == [(1, "2023-02"), (2, "2023-01")]
    assert {r.v for r in begun.collect()} == {1}
    # Another writer publishes while this one's load is on its way.
    load = published.stage(monthly(spark, 3, 3).filter("snapshot_date = '2023-01-01'"), path)
    published.write(monthly(spark, 4, 4).filter("snapshot_date = '2023-02-01'").withColumn("more", F.lit("m")), path)
    published.publish(spark, load, jan)
    assert held(spark, path) == [(3, "2023-01"), (4, "2023-02")]
    assert published.read(spark, path).filter("more is null").count() == 3
    assert published.manifest(spark, path).version == 4
    files = published._Files(spark, path)
    files.write("a", "1"), files.write("b", "2")
    assert not files.claim("a", "b") and files.read("b") == "2" and files.claim("b", "c") and "a" not in files.names()
    published.stage(monthly(spark, 5, 5), path)
    assert published.vacuum(spark, path) == 1 and published.vacuum(spark, path) == 0
    assert held(spark, path) == [(3, "2023-01"), (4, "2023-02")]


def test_emptied_tables_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    observed = published.write(monthly(spark, 1, 1).withColumn("Customer_ID", F.nullif("Customer_ID", F.lit("C0"))), path)
    assert observed == {"rows": 5, "without_customer": 2, "first_month": date(2023, 1, 1), "last_month": date(2023, 2, 1)}
    observed = published.write(monthly(spark, 1, 1).filter("false"), path, [date(2023, 1, 1), date(2023, 2, 1)])
    assert observed == {"rows": 0, "without_customer": 0, "first_month": None, "last_month": None}
    assert published.read(spark, path).columns == ["Customer_ID", "v", "snapshot_date"] and published.read(spark, path).count() == 0
    undated = monthly(spark, 7, 8).withColumn("snapshot_date", F.expr("nullif(snapshot_date, date'2023-02-01')"))
    published.write(undated, path)
    assert sorted((r.v, r.snapshot_date is None) for r in published.read(spark, path).distinct().collect()) == [(7, False)] * 3 + [(8, True)] * 2


def test_each_run_adds_its_metrics(spark, tmp_path):
    root, others = str(tmp_path), others_of(spark)
    raw = {**others, "loans": loan_rows(spark, [(1, 0, date(2023, 1, 1), 0), (2, 0, date(2023, 2, 1), 0)])}
    with pytest.raises(FileNotFoundError, match="no loads"):
        layers.load_metrics(spark, root)
    for month in month_starts(date(2023, 1, 1), date(2023, 3, 1)):
        layers.run_backfill(spark, raw, root, [month])
    kept = layers.load_metrics(spark, root)
    assert kept.count() == 27 and kept.select("run").distinct().count() == 3
    loans = kept.filter("layer = 'silver' and table = 'loans'").orderBy("loaded_at").collect()
    assert [(r["rows"], str(r.first_month)) for r in loans] == [(1, "2023-01-01"), (1, "2023-02-01"), (0, "None")]


def test_window_prunes_directories(spark, backfilled):
    root, _ = backfilled
    loans = layers.load_window(spark, root, date(1996, 1, 1), date(1996, 2, 1))[0]
    assert {str(r[0]) for r in loans.select("snapshot_date").distinct().collect()} == {"1996-01-01", "1996-02-01"}
    assert "PartitionFilters: [isnotnull(snapshot_date" in loans._jdf.queryExecution().executedPlan().toString()


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no gold data"):
        layers.read_table(spark, str(tmp_path), "gold", "model_predictions")
    with pytest.raises(FileNotFoundError, match="no models"):
        bank.load(spark, str(tmp_path))


def test_raw_text_keeps_what_inference_would_change(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Customer_ID,Name,Age,SSN,Occupation,snapshot_date\n007,n,23,1,x,2023-01-01\n")
    assert layers.read_raw(spark, str(tmp_path), "attributes").first().Customer_ID == "007"


def test_raw_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("snapshot_date,Extra,Age,Customer_ID\n2023-01-01,e,23,C1\n")
    (tmp_path / "b.csv").write_text("Customer_ID,Name,Age,SSN,Occupation,snapshot_date\nC2,n,41,1,Lawyer,2023-01-01\n")
    raw = layers.read_raw(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "attributes")
    assert raw.columns == list(S.ATTRIBUTES)
    got = {r.Customer_ID: r for r in silver.clean_attributes(raw.withColumn("Unknown", F.lit("u"))).collect()}
    assert (got["C1"].Age, got["C1"].Occupation, got["C2"].Age, got["C2"].Occupation) == (23, None, 41, "Lawyer")
    bare = spark.createDataFrame([("C3", "2023-01-01")], "Customer_ID string, snapshot_date string")
    assert silver.clean_financials(bare).columns == silver.clean_attributes(bare).columns == bare.columns
    assert silver.clean_financials(bare.withColumn("Num_of_Loan", F.lit("99"))).first().Num_of_Loan == 0
    with pytest.raises(ValueError, match="no column of loans"):
        (tmp_path / "c.csv").write_text("x,y\n1,2\n")
        layers.read_raw(spark, str(tmp_path / "c.csv"), "loans")


@pytest.fixture(scope="module")
def trained(spark, backfilled):
    root, _ = backfilled
    store = layers.read_table(spark, root, "gold", "label_store")
    # Five trees are enough to exercise every step.
    return store, training.train(store, training_windows(Q.SNAPSHOT), {"n_estimators": 5})


def test_scores_are_probabilities_and_repeat(spark, trained):
    store, model = trained
    scored = scoring.predictions(store, model)
    low, high, n = scored.agg(F.min("model_predict_proba"), F.max("model_predict_proba"), F.count("*")).first()
    assert 0 <= low <= high <= 1 and n == store.count()
    again = training.train(store.union(store.limit(300)), model.windows, {"n_estimators": 5})
    assert rows(scoring.predictions(store, again)) == rows(scored)
    assert rows(scoring.predictions(store.union(store), model)) == rows(scored)
    with pytest.raises(ValueError, match="nothing to score"):
        scoring.predictions(store, model, date(2050, 1, 1))


def test_jobs_do_not_remove_each_others_results(spark):
    one, two = session.scratch(spark), session.scratch(spark)
    one.__enter__()
    mine = session.stored(spark.range(3), "mine")
    two.__enter__()
    other = session.stored(spark.range(5), "other")
    one.__exit__(None, None, None)
    assert other.count() == 5
    two.__exit__(None, None, None)
    for gone in (mine, other):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(gone.inputFiles()[0]).count()


def test_scoring_one_month(spark, trained):
    store, model = trained
    month = date(2000, 5, 1)
    scored = scoring.predictions(store, model, month)
    assert scored.count() == store.filter(F.col("snapshot_date") == F.lit(month)).count() > 0


def test_bank_returns_the_latest_and_the_named(spark, trained, tmp_path):
    store, model = trained
    bank.save(spark, model, str(tmp_path), training.evaluate(model, store))
    other = training.Trained(model.model, model.preprocessing, training_windows(date(2000, 12, 1)), model.params, model.pos_weight)
    bank.save(spark, other, str(tmp_path))
    assert bank.load(spark, str(tmp_path)).version == other.version
    loaded = bank.load(spark, str(tmp_path), model.version)
    assert rows(scoring.predictions(store, loaded)) == rows(scoring.predictions(store, model))
    again = bank.save(spark, loaded, str(tmp_path))
    assert bank.find(spark, str(tmp_path), model.version).path == again
    assert rows(scoring.predictions(store, bank.load(spark, str(tmp_path), model.version))) == rows(scoring.predictions(store, model))
    with pytest.raises(FileNotFoundError, match="no model nothing"):
        bank.load(spark, str(tmp_path), "nothing")


def test_evaluation_covers_the_splits_and_learns(spark, trained):
    store, model = trained
    got = {r.split: r for r in training.evaluate(model, store).collect()}
    assert set(got) == {"train", "dev", "oot"} and got["train"].auc > 0.5


def test_no_rows_is_an_error(spark, trained):
    store, model = trained
    with pytest.raises(ValueError, match="no rows to train on"):
        training.train(store, training_windows(date(2020, 1, 1)))


def test_search_draws_distinct_points_and_keeps_the_best(spark, trained):
    drawn = training.draw_params(100)
    assert len({tuple(d.items()) for d in drawn}) == 100
    store, model = trained
    small = {**training.SEARCH_GRID, "n_estimators": [2], "max_depth": [2]}
    split = training.with_categories(training.with_split(store, model.windows).filter("split = 'train'"))
    matrix = training.assembled(model.preprocessing.transform(split, training.KEEP)).withColumn("weight", F.lit(1.0)).cache()
    best, trials = training.search(matrix, draws=2, grid=small)
    assert len(trials) == 2 and best.getOrDefault("stepSize") == max(trials, key=lambda t: t["mean_auc"])["learning_rate"]


def test_fewer_rounds_are_the_first_trees(spark, trained):
    """An ensemble cut to its first trees scores like one fitted with so many, so draws may share a fit."""
    rng = random.Random(3)
    rows = [(float(k % 3 == 0), 1.0, Vectors.dense([rng.random() + (k % 3 == 0) * 0.2, rng.random()])) for k in range(300)]
    matrix = spark.createDataFrame(rows, ["label", "weight", "features"])
    trees, params = training.booster(), {**training.DEFAULT_PARAMS, "n_estimators": 6}
    whole = trees.fit(matrix, training.param_map(trees, params))
    short = trees.fit(matrix, training.param_map(trees, {**params, "n_estimators": 3}))
    cut = training.first_trees(whole, 3)
    probability = lambda m: [r.probability for r in m.transform(matrix).select("probability").collect()]
    assert probability(cut) == probability(short) != probability(whole) and training.first_trees(whole, 6) is whole


def test_draws_that_differ_in_rounds_share_a_fit():
    points = [{"n_estimators": n, "max_depth": d} for d in (2, 3) for n in (50, 25)] + [{"n_estimators": 25, "max_depth": 4}]
    assert training.families(points) == [({"max_depth": 2}, [25, 50]), ({"max_depth": 3}, [25, 50]), ({"max_depth": 4}, [25])]
    assert len(training.families(training.draw_params(100))) < 80


def test_draws_that_differ_in_bounds_that_never_bind_share_a_fit(spark, monkeypatch):
    """The scores are those of separate fits; a fit is saved only where the looser one kept the tighter bounds."""
    rng = random.Random(4)
    rows = [(k, f"l{k}", float(k % 3 == 0), 1.0, Vectors.dense([rng.random() + (k % 3 == 0) * 0.3, float(k < 4)])) for k in range(240)]
    matrix = spark.createDataFrame(rows, ["k", "loan_id", "label", "weight", "features"]).coalesce(1).cache()
    fits, fit = [], training.GBTClassifier.fit
    monkeypatch.setattr(training.GBTClassifier, "fit", lambda self, df, params=None: fits.append(params) or fit(self, df, params))
    grid = {"n_estimators": [1, 2], "max_depth": [1, 2], "learning_rate": [0.1], "subsample": [0.8], "colsample_bytree": [1.0], "gamma": [0, 10.0], "min_child_weight": [1, 60]}
    _, shared = training.search(matrix, draws=16, parallelism=4, grid=grid)
    n_shared = len(fits)
    monkeypatch.setattr(training, "same_trees", lambda *_: False)
    _, alone = training.search(matrix, draws=16, parallelism=4, grid=grid)
    # Without sharing eight families and three folds; with it, the four without a split are one. Each search refits its best.
    assert len(fits) - n_shared == 25 and n_shared <= 16
    assert shared == alone and len(shared) == 16


def test_fits_share_the_cores_that_one_leaves_idle():
    """Five parts on six cores were fitted one after another, as one part was on a single core."""
    assert training.fits_at_once(6, 5) == 6 and training.fits_at_once(8, 1) == 8
    assert training.fits_at_once(1, 1) == 1 and training.fits_at_once(6, 30) == training.fits_at_once(6, 1000) == 1
    assert training.fits_at_once(1000, 500) == 10


def test_what_a_looser_fit_stands_for():
    seen = training.Bounds(2, 0.02, 4)
    fitted = {"max_depth": 2, "gamma": 0, "min_child_weight": 1, "subsample": 0.8}
    same = lambda asked, seen=seen, **f: training.same_trees({**fitted, **f}, seen, {**fitted, **asked})
    assert same({"min_child_weight": 4}) and same({"gamma": 0.02, "min_child_weight": 3})
    assert not same({"min_child_weight": 5}) and not same({"gamma": 0.1}) and not same({"subsample": 0.6}) and not same({"max_depth": 1})
    assert not same({"min_child_weight": 1}, min_child_weight=3) and not same({"gamma": 0}, gamma=0.01)
    leaves = training.Bounds(0, float("inf"), 1 << 40)
    assert same({"max_depth": 1, "gamma": 9, "min_child_weight": 9}, leaves) and not same({"max_depth": 3}, leaves)
    kept = training.chains(training.families(training.draw_params(100)))
    assert len(kept) == 8 and sum(map(len, kept)) == len(training.families(training.draw_params(100)))


def test_a_backfill_keeps_no_shuffle_files(spark, frame, tmp_path):
    """Each write removes its own; kept until a collection, those of all nine would be on disk together."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    month = date(2023, 1, 1)
    raw = {t: frame(", ".join(S.TABLES[t]), [["1"] * (len(S.TABLES[t]) - 1) + ["2023-01-01"]]) for t in S.TABLES}
    setting, before = spark.conf.get(session.SHUFFLE_CLEANUP), shuffled()
    assert layers.run_backfill(spark, raw, str(tmp_path), [month])["silver.loans"] == 1
    for _ in range(50):
        kept = shuffled() - before
        if not kept:
            break
        time.sleep(0.2)
    assert not kept and spark.conf.get(session.SHUFFLE_CLEANUP) == setting
    # A result that is asked for again is made again where its shuffle is gone.
    with session.no_shuffle_kept(spark):
        counts = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
        assert sorted(counts.collect()) == sorted(counts.collect()) and counts.count() == 7


def test_no_loan_is_looked_up_where_all_are_wanted(spark):
    months = [date(2023, m, 1) for m in range(1, 10)]
    rows = [(f"c{k}", f"l{k}", months[(k + m) % 9], 40 * (k % 2) if m else None, m or None, m == 0) for k in range(12) for m in (0, 1, 2) if (k, m) != (5, 2)]
    state = spark.createDataFrame(rows, "Customer_ID string, loan_id string, snapshot_date date, max_dpd int, max_mob int, anchored boolean")
    listed = lambda df: sorted(map(tuple, df.collect()))
    some = gold.labels_of_months(state, months[:6], 2)
    every = gold.labels_of_months(state, months[:6], 2, most=True)
    assert listed(every) == listed(some) != [] and "Join" not in every._jdf.queryExecution().toString()
    touched = gold.months_touched(state, None, 2)
    assert listed(touched) == listed(gold.months_touched(state, state, 2)) != [] and "Join" not in touched._jdf.queryExecution().toString()


def test_a_folder_of_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Customer_ID,Name,Age,snapshot_date\n1,Ann,30,2023-01-01\n")
    (tmp_path / "b.csv").write_text("snapshot_date,other,Age,Customer_ID\n2023-02-01,x,40,2\n2023-02-01,x,41,3\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv.gz").write_bytes(gzip.compress(b"Age,Customer_ID\n50,4\n"))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.csv").write_text("")
    for path in (str(tmp_path), f"{tmp_path}/*"):
        got = {r.Customer_ID: (r.Age, r.Name, r.snapshot_date) for r in layers.read_raw(spark, path, "attributes").collect()}
        assert got == {"1": ("30", "Ann", "2023-01-01"), "2": ("40", None, "2023-02-01"), "3": ("41", None, "2023-02-01"), "4": ("50", None, None)}


def test_overlap_is_empty_with_one_loan_per_customer(spark):
    tagged = spark.createDataFrame([("a", "train"), ("b", "dev"), ("c", "oot"), (None, "dev"), (None, "oot")], "Customer_ID string, split string")
    assert {r.shared_customers for r in audit.customer_overlap(tagged).collect()} == {0}
    shared = tagged.union(spark.createDataFrame([("a", "oot")], tagged.schema))
    assert {r.pair: r.shared_customers for r in audit.customer_overlap(shared).collect()}["train_oot"] == 1
