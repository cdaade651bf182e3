"""Training: time split, preprocessing fitted on train only, boosted trees, evaluation."""

from __future__ import annotations

import itertools
import math
import random
import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lendscape import schemas as S
from lendscape.functions import columns as C
from lendscape.functions.dates import Windows
from lendscape.operators import encoding
from lendscape.operators.ranks import grouped_auc, histogram
from lendscape.plans.gold import one_row_per_loan
from lendscape.session import scratch, stored

SPLIT_SEED = 88
MODEL_SEED = 88
SEARCH_SEED = 42
KEEP = ["loan_id", "Customer_ID", "snapshot_date", "label"]

# Parameters of a run without search, and the grid a search draws from.
DEFAULT_PARAMS = {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8}
SEARCH_GRID = {
    "n_estimators": [25, 50],
    "max_depth": [2, 3],
    "learning_rate": [0.01, 0.1],
    "subsample": [0.6, 0.8],
    "colsample_bytree": [0.6, 0.8],
    "gamma": [0, 0.1],
    "min_child_weight": [1, 3, 5],
}
SEARCH_DRAWS = 100
ROUNDS = "n_estimators"
FOLDS = 3
PARTITION_BYTES = 32 << 20


def with_categories(store: DataFrame) -> DataFrame:
    """The categories that get encoded, none of them null."""
    return store.withColumns(
        {
            "Spend_Level": C.spend_level(),
            "Payment_Value": C.payment_value(),
            "Occupation": F.coalesce("Occupation", F.lit("Unknown")),
        }
    )


def hash_share(key: Column, seed: int) -> Column:
    """A loan's fixed position in [0, 1), spread by MD5: no shuffle, same in any run or engine."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**8))


def with_split(store: DataFrame, windows: Windows, dev_share: float = 0.2, seed: int = SPLIT_SEED) -> DataFrame:
    """Tag rows of the run's windows train, dev or oot; rows outside are dropped.

    Within a label, loans fall to dev independently of everything else, so the share holds per
    label up to chance; ``split_balance`` reports it.
    """
    segment = windows.segment(F.col("snapshot_date"))
    inside = store.withColumn("_segment", segment).filter("_segment != 'unused'")
    split = (
        F.when(F.col("_segment") == "OOT", "oot")
        .when(hash_share(F.col("loan_id"), seed) < dev_share, "dev")
        .otherwise("train")
    )
    return inside.withColumn("split", split).drop("_segment")


def split_balance(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("split").agg(
        F.count("*").alias("n"), F.sum("label").alias("n_bad"), F.round(F.avg("label"), 6).alias("bad_rate")
    )


def class_balance(rows: DataFrame) -> DataFrame:
    """Positives, negatives and the weight that evens them out (1.0 without positives)."""
    pos, neg = F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))
    return rows.agg(
        pos.alias("positives"), neg.alias("negatives"), F.coalesce(F.try_divide(neg, pos), F.lit(1.0)).alias("pos_weight")
    )


def assembled(matrix: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=S.FEATURES, outputCol="features").transform(matrix)


def booster() -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=MODEL_SEED)


def param_map(trees: GBTClassifier, params: dict) -> dict:
    """Spark's parameters for the usual names.

    ``gamma`` and ``min_child_weight`` map to the nearest thing Spark has; L1 and L2 leaf penalties
    have no counterpart.
    """
    return {
        trees.maxIter: params["n_estimators"],
        trees.maxDepth: params["max_depth"],
        trees.stepSize: params["learning_rate"],
        trees.subsamplingRate: params["subsample"],
        trees.featureSubsetStrategy: str(params["colsample_bytree"]),
        trees.minInfoGain: float(params.get("gamma", 0)),
        trees.minInstancesPerNode: params.get("min_child_weight", 1),
    }


def draw_params(draws: int, grid: dict = SEARCH_GRID, seed: int = SEARCH_SEED) -> list[dict]:
    """Distinct random points of the grid."""
    points = list(itertools.product(*grid.values()))
    picked = random.Random(seed).sample(points, min(draws, len(points)))
    return [dict(zip(grid, p, strict=True)) for p in picked]


def with_folds(rows: DataFrame, folds: int = FOLDS, seed: int = SEARCH_SEED) -> DataFrame:
    """Adds ``fold``, stratified: each label is cut into equal parts along a hash of the loan.

    The cuts, ``folds - 1`` per label, come from a sketch.
    """
    share = hash_share(F.col("loan_id"), seed)
    parts = [k / folds for k in range(1, folds)]
    cuts = rows.groupBy("label").agg(F.percentile_approx(share, parts, 10_000).alias("cuts")).collect()
    fold = F.lit(0)
    for row in cuts:
        passed = sum(((share > F.lit(c)).cast("int") for c in row["cuts"]), F.lit(0))
        fold = F.when(F.col("label") == row["label"], passed).otherwise(fold)
    return rows.withColumn("fold", fold)


def matrix_partitions(rows: int) -> int:
    """As few as hold PARTITION_BYTES of features each: a fit is hundreds of small jobs over all of them."""
    return max(1, math.ceil(rows * len(S.FEATURES) * 8 / PARTITION_BYTES))


def fits_at_once(cores: int, parts: int) -> int:
    """How many fits share the cores: one alone leaves them idle between its small jobs, so each core has five tasks to choose from.

    A fit keeps its rows, so no more run than there are cores, and a matrix that fills the cores by itself is fitted once at a time.
    """
    return max(1, min(cores, math.ceil(5 * cores / parts)))


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble after ``n`` rounds of boosting: what a fit of ``n`` rounds with the same settings would be."""
    if n >= model.getNumTrees:
        return model
    spark = SparkSession.active()
    gateway, java = spark.sparkContext._gateway, model._java_obj
    trees = gateway.new_array(spark._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = java.trees()[k], java.treeWeights()[k]
    made = spark._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    return GBTClassificationModel(made.setFeaturesCol("features"))


def families(points: Sequence[dict]) -> list[tuple[dict, list[int]]]:
    """Points that differ only in the number of rounds share a fit: the settings, and the rounds asked for."""
    found: dict[tuple, list[int]] = {}
    for point in points:
        found.setdefault(tuple((k, v) for k, v in point.items() if k != ROUNDS), []).append(point[ROUNDS])
    return [(dict(key), sorted(set(rounds))) for key, rounds in found.items()]


@dataclass
class Bounds:
    """What the trees of a fit show: how deep they go, the least gain of a split and the fewest rows below one."""

    depth: int
    gain: float
    rows: int

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Bounds:
        found, rows, depth = [], [], 0
        for tree in model._java_obj.trees():
            depth = max(depth, tree.depth())
            nodes = [tree.rootNode()] if tree.depth() else []
            while nodes:
                node = nodes.pop()
                found.append(node.gain())
                for child in (node.leftChild(), node.rightChild()):
                    rows.append(child.impurityStats().rawCount())
                    if child.subtreeDepth():
                        nodes.append(child)
        return cls(depth, min(found, default=math.inf), min(rows, default=sys.maxsize))


def same_trees(fitted: dict, seen: Bounds, asked: dict) -> bool:
    """Whether a fit of the settings ``asked`` would grow the trees that the looser ``fitted`` grew.

    A bound takes splits away and adds none. Where every split that was chosen is within the tighter bounds too, each was
    the best of fewer. Another depth is told only where no tree has a split: the draws of features go on below others.
    """
    loose, tight = ({"gamma": 0, "min_child_weight": 1, **s} for s in (fitted, asked))
    free = ("max_depth", "gamma", "min_child_weight")
    if any(loose[k] != tight[k] for k in loose if k not in free):
        return False
    if loose["gamma"] > tight["gamma"] or loose["min_child_weight"] > tight["min_child_weight"]:
        return False
    if loose["max_depth"] != tight["max_depth"] and (loose["max_depth"] < tight["max_depth"] or seen.depth):
        return False
    return seen.gain >= tight["gamma"] and seen.rows >= tight["min_child_weight"]


def chains(found: Sequence[tuple[dict, list[int]]]) -> list[list[tuple[dict, list[int]]]]:
    """Families that only bounds tell apart, the loosest first. Those of one bound on gain above 0 read off the same numbers of rounds.

    Such a bound often leaves no split to any of them, and then one fit serves them all.
    """
    bounds = {"max_depth": lambda s: -s["max_depth"], "gamma": lambda s: s.get("gamma", 0), "min_child_weight": lambda s: s.get("min_child_weight", 1)}
    alike: dict[tuple, list[tuple[dict, list[int]]]] = {}
    for settings, rounds in found:
        alike.setdefault(tuple((k, v) for k, v in settings.items() if k not in bounds), []).append((settings, rounds))
    out = []
    for members in alike.values():
        every: dict[float, set[int]] = {}
        for settings, rounds in members:
            every.setdefault(settings.get("gamma", 0), set()).update(rounds)
        members = [(s, sorted(every[s["gamma"]]) if s.get("gamma", 0) else r) for s, r in members]
        out.append(sorted(members, key=lambda m: tuple(bounds[k](m[0]) for k in ("gamma", "max_depth", "min_child_weight"))))
    return out


def search(
    train: DataFrame, draws: int = SEARCH_DRAWS, parallelism: int = 1, grid: dict = SEARCH_GRID
) -> tuple[Model, list[dict]]:
    """Cross-validated random search by AUC; the best draw is refitted on all training rows.

    Draws that differ only in the number of boosting rounds are one fit, read off at each of its numbers: boosting
    adds a tree to those before it and changes none. Draws that differ only in bounds which the trees of the looser one
    keep anyway are one fit, too. ``parallelism`` chains of such draws, of any fold, run side by side.
    """
    points = draw_params(draws, grid)
    trees = booster()
    # The score column holds every distinct score: no binning of the curve.
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    folded = with_folds(train).select("fold", "label", "weight", "features")
    sides = [(folded.filter(F.col("fold") != k).persist(), folded.filter(F.col("fold") == k).persist()) for k in range(FOLDS)]

    def fitted(job: tuple[int, list[tuple[dict, list[int]]]]) -> list[tuple[tuple, float]]:
        k, chain = job
        learn, check = sides[k]
        done: list[tuple[dict, Bounds, dict[int, float]]] = []
        out = []
        for at, (settings, rounds) in enumerate(chain, 1):
            aucs = next((a for s, seen, a in done if a.keys() >= set(rounds) and same_trees(s, seen, settings)), None)
            if aucs is None:
                model = trees.fit(learn, param_map(trees, {**settings, ROUNDS: rounds[-1]}))
                aucs = {n: evaluator.evaluate(first_trees(model, n).transform(check)) for n in rounds}
                # Thousands of calls to the driver's JVM, in vain where no draw follows.
                if at < len(chain):
                    done.append((settings, Bounds.of(model), aucs))
            out += [((*sorted(settings.items()), n), aucs[n]) for n in rounds]
        return out

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            jobs = list(itertools.product(range(FOLDS), chains(families(points))))
            # The longest chains first, so that none is left running alone.
            jobs.sort(key=lambda job: -len(job[1]))
            found = list(itertools.chain.from_iterable(pool.map(inheritable_thread_target(fitted), jobs)))
    finally:
        for side in itertools.chain.from_iterable(sides):
            side.unpersist()
    scores: dict[tuple, list[float]] = {}
    for key, auc in found:
        scores.setdefault(key, []).append(auc)

    def mean(point: dict) -> float:
        own = scores[(*sorted((k, v) for k, v in point.items() if k != ROUNDS), point[ROUNDS])]
        return sum(own) / len(own)

    ranked = [{**point, "mean_auc": mean(point)} for point in points]
    best = max(ranked, key=lambda t: t["mean_auc"])
    return trees.fit(train, param_map(trees, best)), ranked


@dataclass
class Trained:
    """Everything scoring needs to repeat the training-time transformations."""

    model: Model
    preprocessing: encoding.Fitted
    windows: Windows
    params: dict
    pos_weight: float
    trials: list[dict] = field(default_factory=list)

    @property
    def version(self) -> str:
        return self.windows.version

    def matrix(self, store: DataFrame, keep: list[str]) -> DataFrame:
        return assembled(self.preprocessing.transform(with_categories(store), keep))

    def score(self, store: DataFrame, keep: list[str] = KEEP) -> DataFrame:
        scored = self.model.transform(self.matrix(store, keep))
        return scored.select(*keep, vector_to_array("probability")[1].alias("model_predict_proba"))


def train(
    store: DataFrame,
    windows: Windows,
    params: dict | None = None,
    tune: bool = False,
    draws: int = SEARCH_DRAWS,
) -> Trained:
    """Fit preprocessing and model on the training split of a store; a repeated loan counts once.

    The training rows and their matrix are stored while fitting, which passes over them many times.
    The encoding map stays stored for as long as the model is in use.
    """
    spark = store.sparkSession
    with scratch(spark):
        inside = store.filter(F.col("snapshot_date").between(F.lit(windows.fit_start), F.lit(windows.fit_end)))
        fit_rows = with_categories(with_split(one_row_per_loan(inside), windows).filter("split = 'train'"))
        fit_rows = stored(fit_rows.select(*KEEP, *S.NUMERIC_FEATURES, *S.CATEGORIES), "train-rows")
        balance = class_balance(fit_rows).first()
        if balance.positives + balance.negatives == 0:
            raise ValueError(f"no rows to train on between {windows.fit_start} and {windows.fit_end}")
        preprocessing = encoding.fit(fit_rows)
        weight = F.when(F.col("label") == 1, F.lit(balance.pos_weight)).otherwise(F.lit(1.0))
        matrix = assembled(preprocessing.transform(fit_rows, KEEP)).withColumn("weight", weight)
        matrix = stored(matrix.select(*KEEP, "weight", "features"), "train-matrix")
        parts = matrix_partitions(balance.positives + balance.negatives)
        matrix = matrix.coalesce(parts)
        if tune:
            model, trials = search(matrix, draws, fits_at_once(spark.sparkContext.defaultParallelism, parts))
            best = max(trials, key=lambda t: t["mean_auc"])
            chosen = {k: v for k, v in best.items() if k != "mean_auc"}
        else:
            chosen, trials = {**DEFAULT_PARAMS, **(params or {})}, []
            trees = booster()
            model = trees.fit(matrix, param_map(trees, chosen))
    return Trained(model, preprocessing, windows, chosen, balance.pos_weight, trials)


def evaluate(trained: Trained, store: DataFrame) -> DataFrame:
    """Rows, bad rate, AUC and Gini per split."""
    tagged = with_split(one_row_per_loan(store), trained.windows)
    scored = trained.score(tagged, [*KEEP, "split"])
    hist = histogram(scored, ["split"], "model_predict_proba", pos=F.col("label"), neg=1 - F.col("label"))
    auc = grouped_auc(hist, ["split"], "model_predict_proba")
    n = F.col("pos") + F.col("neg")
    return auc.select(
        "split",
        n.alias("n"),
        F.round(F.col("pos") / n, 3).alias("bad_rate"),
        F.round("auc", 4).alias("auc"),
        F.round("gini", 3).alias("gini"),
    )
