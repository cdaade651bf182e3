"""Rank statistics, drift and rates against brute force and against their own laws."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscape.operators import drift, encoding, profiling, ranks, rates


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def auc_of(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "g string, s double, y int")
    hist = ranks.histogram(df, ["g"], "s", pos=F.col("y"), neg=1 - F.col("y"))
    return {r.g: r.auc for r in ranks.grouped_auc(hist, ["g"], "s", **kwargs).collect()}


def scored(seed, groups=4, n=600):
    rng = random.Random(seed)
    spread = {g: rng.choice([1, 10, 1000]) for g in range(groups)}
    # The first group holds a third of the rows; scores lie far apart between groups.
    picks = [0 if rng.random() < 1 / 3 else rng.randrange(groups) for _ in range(n)]
    return [(f"g{g}", round(rng.gauss(0, 1) * spread[g], rng.choice([0, 1, 6])), int(rng.random() < 0.3)) for g in picks]


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_matches_pair_counting(spark, seed):
    rows = scored(seed)
    got = auc_of(spark, rows)
    for g in {r[0] for r in rows}:
        assert got[g] == pytest.approx(brute_auc([(s, y) for k, s, y in rows if k == g]), abs=1e-12)


def test_auc_laws(spark):
    rows = scored(3, groups=1)
    base = auc_of(spark, rows)["g0"]
    assert auc_of(spark, [(g, float(np.arctan(s)), y) for g, s, y in rows])["g0"] == pytest.approx(base, abs=1e-12)
    assert auc_of(spark, [(g, -s, y) for g, s, y in rows])["g0"] == pytest.approx(1 - base, abs=1e-12)


def test_auc_edges(spark):
    rows = [("one class", 0.1, 1), ("one class", 0.2, 1), ("tied", 0.5, 1), ("tied", 0.5, 0)]
    rows += [("perfect", 0.1, 0), ("perfect", 0.9, 1)]
    assert auc_of(spark, rows) == {"one class": None, "tied": 0.5, "perfect": 1.0}
    assert auc_of(spark, []) == {}


def test_cells_stay_small_when_one_group_holds_everything(spark):
    df = spark.range(64_000).select(F.lit("hot").alias("g"), F.pow(F.col("id"), 3.0).alias("s"))
    sliced = ranks.with_slice(ranks.histogram(df, ["g"], "s"), "s")
    biggest = sliced.groupBy("g", "_slice").count().agg(F.max("count")).first()[0]
    assert biggest <= 2 * 64_000 / ranks.SLICES


@pytest.mark.parametrize("n", [300, 3_000, 30_000])
def test_cells_do_not_grow_with_the_data(spark, n):
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("other").alias("g"), F.exp(F.col("id") % 17).alias("tied"), "id")
    hist = ranks.histogram(rows.withColumn("s", F.col("tied") + F.col("id") / n), ["g"], "s")
    levels = ranks.cut_levels(hist, 20)
    assert levels == {300: 1, 3_000: 2, 30_000: 2}[n]
    cells = ranks.with_slice(hist, "s", levels).groupBy("_slice").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    found = cells.orderBy("_slice").collect()
    assert sum(c.n for c in found) == n and max(c.n for c in found) <= 2 * 20
    # Slices lie behind each other on the axis.
    assert all(a.hi < b.lo for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("cell_rows", [1, 3, 50])
def test_deeper_cuts_change_no_result(spark, cell_rows):
    rows = scored(6, n=400)
    assert auc_of(spark, rows, cell_rows=cell_rows) == pytest.approx(auc_of(spark, rows), abs=1e-12)
    probs = [0.0, 0.3, 0.5, 1.0]
    hist = ranks.histogram(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s")
    got = {(r.g, r.prob): r.quantile for r in ranks.grouped_quantiles(hist, ["g"], "s", "n", probs, cell_rows).collect()}
    for g in {r[0] for r in rows}:
        values = [s for k, s, _ in rows if k == g]
        assert [got[g, p] for p in probs] == pytest.approx(list(np.quantile(values, probs)), abs=1e-9)


def test_three_levels(spark):
    df = spark.range(9_000).select(F.lit("g").alias("g"), F.sqrt("id").alias("s"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    hist = ranks.histogram(df, ["g"], "s", pos=F.col("y"), neg=1 - F.col("y"), n=F.lit(1))
    assert ranks.cut_levels(hist, 2) == 3
    deep, flat = (ranks.grouped_auc(hist, ["g"], "s", cell_rows=c).first().auc for c in (2, 10_000))
    assert deep == pytest.approx(flat, abs=1e-12)
    got = ranks.grouped_quantiles(hist, ["g"], "s", "n", [0.25, 0.9], 2).collect()
    values = np.sqrt(np.arange(9_000))
    assert {r.prob: r.quantile for r in got} == pytest.approx({p: np.quantile(values, p) for p in (0.25, 0.9)}, abs=1e-9)


@pytest.mark.parametrize("seed", [4, 5])
def test_quantiles_match_numpy(spark, seed):
    rows = [(g, s) for g, s, _ in scored(seed, n=300)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    hist = ranks.histogram(spark.createDataFrame(rows, "g string, s double"), ["g"], "s")
    got = {(r.g, r.prob): r.quantile for r in ranks.grouped_quantiles(hist, ["g"], "s", "n", probs).collect()}
    for g in {r[0] for r in rows}:
        values = [s for k, s in rows if k == g]
        assert [got[g, p] for p in probs] == pytest.approx(list(np.quantile(values, probs)), abs=1e-9)


def test_quantiles_of_copies(spark):
    df = spark.createDataFrame([("g", 7)] * 50 + [("g", 9)], "g string, v int")
    got = ranks.grouped_quantiles(ranks.histogram(df, ["g"], "v"), ["g"], "v", "n", [0.5, 1.0]).collect()
    assert {r.prob: r.quantile for r in got} == {0.5: 7.0, 1.0: 9.0}


@pytest.mark.parametrize("n", [1, 2, 7, 10, 49, 5000])
def test_bracketed_median_is_exact(spark, n):
    rng = np.random.default_rng(n)
    holes = [None if rng.random() < 0.3 else float(x) for x in rng.normal(size=n)]
    tied = [float(x) for x in rng.choice([0, 0, 0, 5, 9], size=n)]
    steep = [float(x) for x in np.exp(rng.normal(size=n) * 4)]
    rows = list(zip(holes, tied, steep, [None] * n, strict=True))
    df = spark.createDataFrame(rows, "holes double, tied double, steep double, empty double")
    got = {r.feature: r.median for r in encoding.medians(df, df.columns).collect()}
    expected = {"tied": np.median(tied), "steep": np.median(steep)}
    if any(h is not None for h in holes):
        expected["holes"] = np.median([h for h in holes if h is not None])
    assert got == pytest.approx(expected, abs=1e-12)


def test_bracket_keeps_few_values(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    assert ranks.bracketed(df, ["x"], 0.5).distinct().count() < 3000


def brute_psi(expected, actual, bins=10):
    edges = np.unique(np.round(np.quantile(expected, np.linspace(0, 1, bins + 1)), 9))
    inner = edges[1:-1]

    def shares(scores):
        counts = np.bincount([int((inner <= s).sum()) for s in scores], minlength=len(inner) + 1)
        return np.clip(counts / max(counts.sum(), 1), 1e-6, None)

    e, a = shares(expected), shares(actual)
    return float(((a - e) * np.log(a / e)).sum())


def predictions(spark, months):
    rows = [(d, float(s), k % 2) for d, scores in months.items() for k, s in enumerate(scores)]
    return spark.createDataFrame(rows, "snapshot_date date, model_predict_proba double, label int")


def test_psi_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    months = {date(2024, 1, 1): rng.random(20), date(2024, 2, 1): rng.random(80), date(2024, 3, 1): rng.random(70) ** 2}
    got = {r.month: r.psi_vs_baseline for r in drift.monthly_metrics(predictions(spark, months)).collect()}
    base = months[date(2024, 2, 1)]
    assert got == pytest.approx({m: round(brute_psi(base, s), 4) for m, s in months.items()}, abs=1.1e-4)
    assert got[date(2024, 2, 1)] == 0 and min(got.values()) >= 0


@pytest.mark.parametrize("base", [[0.5] * 60, [0.2] * 30 + [0.8] * 30])
def test_psi_of_a_baseline_with_few_edges(spark, base):
    months = {date(2024, 1, 1): base, date(2024, 2, 1): [0.1] * 60}
    got = {r.month.month: r.psi_vs_baseline for r in drift.monthly_metrics(predictions(spark, months)).collect()}
    assert got[1] == 0
    assert got[2] == pytest.approx(brute_psi(base, [0.1] * 60), abs=1e-4)


def test_baseline_falls_back_to_the_earliest_month(spark):
    hist = drift.score_histogram(predictions(spark, {date(2024, 2, 1): [0.1] * 3, date(2024, 1, 1): [0.1] * 2}))
    assert drift.baseline_month(hist).first()[0] == date(2024, 1, 1)


def test_drift_verdict_reads_the_latest_month(spark):
    rows = [(date(2024, 1, 1), 0.3), (date(2024, 2, 1), 0.1), (date(2024, 3, 1), None)]
    table = spark.createDataFrame(rows, "month date, psi_vs_baseline double")
    row = drift.drift_verdict(table).first()
    assert (row.month, row.verdict) == (date(2024, 2, 1), "MODERATE DRIFT -> monitor closely")
    classes = spark.createDataFrame([(0.25,), (0.2499,), (0.0999,)], "psi double").select(drift.drift_class(F.col("psi")))
    assert [r[0].split(" ")[0] for r in classes.collect()] == ["MAJOR", "MODERATE", "STABLE"]


def test_correlation_drops_constants_and_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=200), (rng.random(200) < 0.4).astype(int)
    rows = [(float(a), 3.0, None if k % 7 == 0 else float(a * b), int(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, flat double, holes double, isDefault int")
    got = {r.feature: r.correlation for r in rates.rank_by_correlation(df, ["a", "flat", "holes"]).collect()}
    kept = np.array([k % 7 != 0 for k in range(200)])
    assert got == pytest.approx({"a": np.corrcoef(x, y)[0, 1], "holes": np.corrcoef((x * y)[kept], y[kept])[0, 1]})


def test_buckets_merge_equal_edges(spark):
    df = spark.createDataFrame([(1.0, 0)] * 6 + [(2.0, 1)] * 4, "v double, isDefault int")
    got = rates.bad_rate_by_bucket(df, ["v"], buckets=4).orderBy("bucket").collect()
    # Quartiles 1, 1 and 2: two edges, and nothing lies below the first.
    assert [(r.bucket, r.Total_Customers, r.Default_Rate_Percent) for r in got] == [(1, 6, 0.0), (2, 4, 100.0)]


def test_target_encoding_smooths_towards_the_mean(spark):
    rows = [("a", 1)] * 20 + [("b", 0)] * 60
    df = spark.createDataFrame(rows, "k string, label int")
    got = {r.category: r.encoded for r in encoding.target_encoding(df, ["k"]).collect()}
    assert got == pytest.approx({"a": (20 + 0.25 * 20) / 40, "b": (0 + 0.25 * 20) / 80})
    fresh = spark.createDataFrame([("a",), ("new",)], "k string")
    applied = encoding.apply_encoding(fresh, encoding.target_encoding(df, ["k"]), F.lit(0.25), ["k"])
    assert {r.k: r.k_TE for r in applied.collect()} == pytest.approx({"a": 0.625, "new": 0.25})


def test_constant_columns_stay_unscaled(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    got = {r.feature: (r["mean"], r["std"]) for r in encoding.scales(df, ["x", "c"]).collect()}
    assert got == {"x": (2.0, 1.0), "c": (5.0, 1.0)}


def test_profiles(spark):
    df = spark.createDataFrame([("1", "x"), ("-2", "x"), ("-2", None), ("3", "y"), (None, "y"), ("1", "junk")], "a string, b string")
    row = profiling.numeric_profile(df, ["a"]).first()
    assert (row.negative_count, row.min, row.max, row["mean"], row["mode"], row["median"]) == (2, -2, 3, pytest.approx(5 / 3), 1, 1)
    assert [tuple(r) for r in profiling.negative_frequency(df, ["a"]).collect()] == [("a", -2.0, 2, 33.33)]
    assert [tuple(r) for r in profiling.value_frequency(df, ["b"]).collect()] == [("b", "x", 2), ("b", "y", 2), ("b", "junk", 1)]
    assert profiling.duplicate_keys(df, "b").first()[0] == 2
    assert {r.feature: r.non_null_percent for r in profiling.coverage(df, ["a", "b"]).collect()} == {"a": 83.3, "b": 83.3}
