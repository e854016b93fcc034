"""Newton boosting with focal loss on distributed regression trees.

One round computes gradients as columns, lets the distributed tree learner find the splits
(label -g/h, weight h, so its leaf mean is the Newton step), and adds the shrunken step to the
score column. Rows never leave the executors; the driver holds trees and a few sums. The scores
of all rows are state: each round moves them by one tree, and what the model predicts for them is
the state of its best round, so no later job has to walk the trees again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelfill.functions import focal
from panelfill.functions.rng import hash_uniform, hash_uniform_py
from panelfill.functions.survey import is_binomial
from panelfill.operators import scores as osc
from panelfill.operators.running import hash_buckets, running_totals
from panelfill.operators.sampling import random_sample
from panelfill.session import checkpoint, in_parallel, new_folder, stored

SPLITS = ("train", "test", "validation")
FINAL_SEED = 47
SEARCH_SEED = 42
PENALTY_ROWS = 2000
GRADIENT_STEPS = 64
LEAST_GRADIENT = 2.0**-64


# ---- rows and targets ------------------------------------------------------------------------


def split_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of a split that have an observed label."""
    return df.where((F.col("set_uid") == name) & F.col("label").isNotNull())


def one_vs_rest(df: DataFrame) -> DataFrame:
    """One row per class with target ``y``; classes come from ``num_class``, so all splits share them.

    A binomial model keeps its positive class only.
    """
    long = df.withColumn("value", F.explode(F.sequence(F.lit(0), F.col("num_class") - 1)))
    scored = ~is_binomial(F.col("attribute_model")) | (F.col("value") == 1)
    return long.where(scored).withColumn("y", (F.col("label") == F.col("value")).cast("double"))


def init_scores(scores: DataFrame, group: Sequence[str], gamma: float, alpha: float | None = None) -> DataFrame:
    """Best constant raw score per group, from the two class counts."""

    @F.pandas_udf("double")
    def search(n1: pd.Series, n0: pd.Series) -> pd.Series:
        return pd.Series([focal.best_constant_score(a, b, gamma, alpha) for a, b in zip(n1, n0)], dtype="float64")

    counts = scores.groupBy(*group).agg(
        F.sum(F.col("y").cast("double")).alias("n1"), F.sum(1.0 - F.col("y").cast("double")).alias("n0")
    )
    return counts.withColumn("init_score", search("n1", "n0"))


def stratified_folds(df: DataFrame, group: Sequence[str], k: int = 5, seed: int = 0, label: str = "label") -> DataFrame:
    """Fold 0..k-1 per row, balanced to one row within each label of each group, in hash order."""
    keyed = df.withColumns(
        {"_u": hash_uniform(F.col("uid"), *[F.col(c) for c in group], seed), "_one": F.lit(1)}
    )
    ranked = running_totals(hash_buckets(keyed, "_u"), [*group, label], ["_u", "uid"], {"_one": "_rank"})
    return ranked.withColumn("fold", F.col("_rank") % k).drop("_u", "_one", "_rank", "all__one")


def class_weights(df: DataFrame, weights: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """Attach the weight of each row's class, scaled so that the heaviest class of a group has 1."""
    top = weights.groupBy(*group).agg(F.max("weight").alias("_top"))
    scaled = weights.join(top, list(group)).select(*group, label, (F.col("weight") / F.col("_top")).alias("class_weight"))
    return df.join(stored(scaled, "class-weights"), [*group, label])


def effective_other_rate(top_rate: float, other_rate: float) -> float:
    return other_rate * (1.0 - top_rate)


def gradient_bin(gradient: Column) -> Column:
    """Bin of a gradient's size on a logarithmic scale: steps of about one percent, at most some 4,000 of them up to a size of 1."""
    return F.floor(F.log2(F.greatest(F.abs(gradient), F.lit(LEAST_GRADIENT))) * GRADIENT_STEPS).cast("int")


def _top_edge(counts: dict[int, int], top_rate: float) -> tuple[int, float]:
    """The bin in which the ``top_rate`` of all rows with the largest gradients end, and the share of its rows that belong to them."""
    left = math.floor(top_rate * sum(counts.values()))
    for bin_, n in sorted(counts.items(), reverse=True):
        if left <= n:
            return bin_, left / n
        left -= n
    return 0, 0.0


def top_edges(histogram: DataFrame, group: Sequence[str], top_rate: float) -> DataFrame:
    """The same for every group of a table (group, bin, n): (group, edge, share). A group has some thousand bins at most."""
    whole = Window.partitionBy(*group)
    above = F.coalesce(F.sum("n").over(whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.floor(F.sum("n").over(whole) * F.lit(float(top_rate))) - above
    placed = histogram.select(*group, "bin", "n", left.alias("left"))
    return placed.where("left >= 0 AND left <= n").groupBy(*group).agg(F.max(F.struct("bin", (F.col("left") / F.col("n")).alias("share"))).alias("e")).select(
        *group, F.col("e.bin").alias("edge"), "e.share"
    )


def _one_sided(df: DataFrame, gradient: str, edge: Column, share: Column, top_rate: float, other_rate: float, seed: int) -> DataFrame:
    bin_ = gradient_bin(F.col(gradient))
    rest = min(1.0, other_rate / (1.0 - top_rate))
    large = (bin_ > edge) | ((bin_ == edge) & (hash_uniform(F.col("uid"), seed, "edge") < share))
    kept = df.withColumn("_large", large).where(F.col("_large") | (hash_uniform(F.col("uid"), seed, "goss") < rest))
    up = (1.0 - top_rate) / other_rate if other_rate > 0 else 0.0
    return kept.withColumn("goss_weight", F.when(F.col("_large"), 1.0).otherwise(max(1.0, up))).drop("_large")


def goss_weights(
    df: DataFrame, gradient: str, top_rate: float, other_rate: float, seed: int, group: Sequence[str] = (), counts: dict[int, int] | None = None
) -> DataFrame:
    """Keep the rows with the largest gradients of every group, a sample of the others, and weigh the sample up.

    ``other_rate`` is the sampled fraction of all rows. How many rows fall into each bin of gradient sizes says in which bin
    the largest ``top_rate`` of them end; of that bin the missing share is drawn by hash of (uid, seed), and so is the sample.
    Bins are counted by an aggregate; one that was counted already (``counts``, without groups) is not counted again.
    """
    if top_rate >= 1.0:
        return df.withColumn("goss_weight", F.lit(1.0))
    histogram = df.groupBy(*group, gradient_bin(F.col(gradient)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if group:
        edges = stored(top_edges(histogram, group, top_rate), "top-edges")
        return _one_sided(df.join(edges, list(group)), gradient, F.col("edge"), F.col("share"), top_rate, other_rate, seed).drop("edge", "share")
    edge, share = _top_edge(counts if counts is not None else {r.bin: r.n for r in histogram.collect()}, top_rate)
    return _one_sided(df, gradient, F.lit(edge), F.lit(share), top_rate, other_rate, seed)


# ---- fitting ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 200
    patience: int = 30
    learning_rate: float = 0.1
    max_depth: int = 4
    num_leaves: int = 4096
    max_bins: int = 64
    min_data_in_leaf: int = 1
    min_sum_hessian_in_leaf: float = 0.0
    min_gain_to_split: float = 0.0
    max_delta_step: float = 0.0
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    top_rate: float = 1.0
    other_rate: float = 0.0
    bagging_fraction: float = 1.0
    feature_fraction: float = 1.0
    gamma: float = 0.5
    alpha: float | None = None
    seed: int = SEARCH_SEED
    checkpoint_every: int = 10
    features: tuple[int, ...] | None = None
    least_bins: int = 2  # bins that the categories need, whatever max_bins says

    @property
    def depth(self) -> int:
        """Depth that also respects the leaf limit."""
        return max(1, min(self.max_depth, math.floor(math.log2(max(2, self.num_leaves)))))

    @property
    def plain_leaves(self) -> bool:
        """Without regularisation the leaf mean of the tree is the Newton step already."""
        return self.lambda_l1 == 0 and self.lambda_l2 == 0 and self.max_delta_step <= 0


@dataclass
class Step:
    tree: DecisionTreeRegressionModel
    features: list[int] | None
    leaves: list[float] | None

    def values(self, df: DataFrame, features: str) -> tuple[DataFrame, Column]:
        """The frame with what the tree needs, and the column of its Newton step."""
        if self.features is not None:
            df = VectorSlicer(inputCol=features, outputCol="_slice", indices=self.features).transform(df)
        source = "_slice" if self.features is not None else features
        tree = self.tree.setFeaturesCol(source)
        if self.leaves is None:
            return tree.setPredictionCol("_step").setLeafCol("").transform(df), F.col("_step")
        out = tree.setPredictionCol("").setLeafCol("_leaf").transform(df)
        table = F.array(*[F.lit(v) for v in self.leaves])
        return out, F.get(table, F.col("_leaf").cast("int"))


@dataclass
class BoostModel:
    params: BoostParams
    init: float
    steps: list[Step] = field(default_factory=list)
    history: list[tuple[float, float]] = field(default_factory=list)  # (train, test) loss after each round
    scores: DataFrame | None = None  # (uid, y, is_train, score) of all rows of the fit, after the best round

    @property
    def best_iteration(self) -> int:
        """Rounds to use: those up to the lowest test loss."""
        losses = [t for _, t in self.history]
        return losses.index(min(losses)) + 1 if losses else 0

    def raw_score(self, df: DataFrame, column: str, features: str = "features") -> DataFrame:
        """Scores of rows that were not in the fit, tree by tree."""
        out = df.withColumn(column, F.lit(self.init))
        for step in self.steps[: self.best_iteration]:
            out, value = step.values(out, features)
            out = out.select(*df.columns, (F.col(column) + F.lit(self.params.learning_rate) * value).alias(column))
        return out


def _picked_features(n: int, params: BoostParams, round_: int) -> list[int] | None:
    """Entries the tree of this round may use: the on/off list, then a hash-chosen fraction of it."""
    pool = list(params.features) if params.features is not None else list(range(n))
    if params.feature_fraction < 1.0:
        size = max(1, round(params.feature_fraction * len(pool)))
        pool = sorted(sorted(pool, key=lambda i: hash_uniform_py(i, round_, params.seed, "feature"))[:size])
    return None if len(pool) == n else pool


def _leaf_values(rows: DataFrame, params: BoostParams, tree: DecisionTreeRegressionModel, source: str) -> list[float]:
    """Regularised Newton step of every leaf, from the sums of gradients and Hessians in it."""
    leafed = tree.setFeaturesCol(source).setPredictionCol("").setLeafCol("_leaf").transform(rows)
    sums = leafed.groupBy("_leaf").agg(F.sum(F.col("g") * F.col("row_weight")).alias("g"), F.sum(F.col("h") * F.col("row_weight")).alias("h")).collect()
    values = [0.0] * (int(max((r["_leaf"] for r in sums), default=0.0)) + 1)
    for r in sums:
        pull = math.copysign(max(0.0, abs(r.g) - params.lambda_l1), r.g)
        step = -pull / (r.h + params.lambda_l2) if r.h + params.lambda_l2 > 0 else 0.0
        if params.max_delta_step > 0:
            step = max(-params.max_delta_step, min(params.max_delta_step, step))
        values[int(r["_leaf"])] = step
    return values


class NoRows(ValueError):
    """A round's sample of the train rows is empty."""


@dataclass
class _Round:
    """What one pass over the scores gives: the loss by split, and of the next round's sample its rows by gradient bin and its Hessian sum."""

    loss: dict[bool, float]
    counts: dict[int, int]
    hessian: float


def _in_bag(params: BoostParams, t: int) -> Column:
    return F.lit(True) if params.bagging_fraction >= 1.0 else hash_uniform(F.col("uid"), params.seed, t, "bag") < params.bagging_fraction


def _judged(scored: DataFrame, params: BoostParams, t: int) -> DataFrame:
    """Scored rows before round ``t`` with ``loss``, gradient ``g`` and Hessian ``h`` of their score, and ``bag``, whether the round's bag holds a train row.

    Where the frame is kept, filters by gradient compare a stored number. They would take its whole expression along below the
    projection otherwise, several times, to methods too long for the JVM to compile.
    """
    y, q = F.col("y"), F.col("_q")
    true_class = focal.true_class_probability(y, focal.sigmoid(F.col("score")))
    return scored.withColumn("_q", F.when(F.col("is_train").isNotNull(), true_class)).select(
        *scored.columns,
        focal.focal_loss_at(y, q, params.gamma, params.alpha).alias("loss"),
        focal.focal_grad_at(y, q, params.gamma, params.alpha).alias("g"),
        focal.newton_hess_at(y, q, params.gamma, params.alpha).alias("h"),
        F.when(F.col("is_train"), _in_bag(params, t)).alias("bag"),
    )


def _measure(state: DataFrame, params: BoostParams, row_weight: Column) -> _Round:
    """One aggregate over the judged state before a round; groups are splits, and gradient bins where a round samples by gradient."""
    bin_ = gradient_bin(F.col("g")) if params.top_rate < 1.0 else F.lit(0)
    bag = F.col("bag")
    rows = state.where(F.col("is_train").isNotNull()).groupBy("is_train", bin_.alias("bin")).agg(
        F.sum("loss").alias("loss"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(bag).alias("bagged"),
        F.sum(F.when(bag, F.col("h") * row_weight)).alias("hessian"),
    )
    found = sorted(rows.collect(), key=lambda r: (r.is_train, r.bin))
    loss = {k: sum(r.loss for r in found if r.is_train is k) / sum(r.n for r in found if r.is_train is k) for k in {r.is_train for r in found}}
    return _Round(loss, {r.bin: r.bagged for r in found if r.bagged}, sum(r.hessian or 0.0 for r in found))


def fit_newton_boost(rows: DataFrame, params: BoostParams) -> BoostModel:
    """Boosted trees on ``rows`` (uid, features, y, is_train[, class_weight]).

    Rows with ``is_train`` fit the trees, those without stop the rounds early, and rows where it is null are
    only scored. Scores are kept, with loss, gradient and Hessian, in a persisted frame that can be recomputed from its parent;
    every ``checkpoint_every`` rounds it is checkpointed to the shared folder, so lineage stays short. After a
    round one aggregate gives its losses and what the next round needs to know of the gradients. The scores
    after the best round are stored as ``scores`` of the model. ``rows`` that are persisted are not copied for the first round.
    """
    if not params.bagging_fraction > 0:
        raise ValueError("bagging_fraction must be above 0")
    extra = ["class_weight"] if "class_weight" in rows.columns else []
    base = rows.select("uid", "features", F.col("y").cast("double").alias("y"), "is_train", *extra)
    copied = not (rows.storageLevel.useMemory or rows.storageLevel.useDisk)
    if copied:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    train = F.when(F.col("is_train"), F.col("y"))
    counts = base.agg(F.sum(train).alias("n1"), F.sum(1.0 - train).alias("n0")).first()
    init = focal.best_constant_score(float(counts.n1 or 0.0), float(counts.n0 or 0.0), params.gamma, params.alpha)
    width = rows.select("features").schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    model = BoostModel(params, init)
    state = _judged(base.withColumn("score", F.lit(init)), params, 0)
    best = state
    row_weight = F.col("class_weight") if extra else F.lit(1.0)
    sampled = params.bagging_fraction < 1.0 or params.top_rate < 1.0 or params.min_sum_hessian_in_leaf > 0 or params.min_gain_to_split > 0
    seen = _measure(state.persist(StorageLevel.MEMORY_AND_DISK), params, row_weight) if sampled else None
    for t in range(params.rounds):
        if seen is not None and not seen.counts:
            raise NoRows(f"no train row is in the sample of round {t}")
        grads = state.where("bag").select("uid", "features", "g", "h", row_weight.alias("row_weight"))
        if params.top_rate < 1.0:
            grads = goss_weights(grads, "g", params.top_rate, params.other_rate, params.seed + t, counts=seen.counts)
            grads = grads.withColumn("row_weight", F.col("row_weight") * F.col("goss_weight"))
        picked = _picked_features(width, params, t) if width else params.features and list(params.features)
        source = "features"
        if picked is not None:
            grads = VectorSlicer(inputCol="features", outputCol="_slice", indices=picked).transform(grads)
            source = "_slice"
        weight_fraction, least_gain, depth = 0.0, 0.0, params.depth
        if params.min_sum_hessian_in_leaf > 0 or params.min_gain_to_split > 0:
            total = seen.hessian  # sampling by gradient keeps it in expectation
            # the tree's gain is per unit of weight, the parameter's is a sum over the rows
            least_gain = params.min_gain_to_split / total if total else 0.0
            weight_fraction = params.min_sum_hessian_in_leaf / total if total else 0.0
            if weight_fraction >= 0.5:  # no split leaves enough on both sides
                weight_fraction, depth = 0.0, 0
        target = grads.withColumns({"target": -F.col("g") / F.col("h"), "w": F.col("h") * F.col("row_weight")})
        sums = [] if params.plain_leaves else ["g", "h", "row_weight"]
        # the tree learner reads its rows several times: gradients and slices are computed once
        target = target.select(source, "target", "w", *sums).persist(StorageLevel.MEMORY_AND_DISK)
        tree = DecisionTreeRegressor(
            featuresCol=source,
            labelCol="target",
            weightCol="w",
            maxDepth=depth,
            maxBins=max(params.max_bins, params.least_bins),
            minInstancesPerNode=max(1, params.min_data_in_leaf),
            minWeightFractionPerNode=weight_fraction,
            minInfoGain=least_gain,
            seed=params.seed + t,
        ).fit(target)
        step = Step(tree, picked, None if params.plain_leaves else _leaf_values(target, params, tree, source))
        target.unpersist()
        model.steps.append(step)
        scored, value = step.values(state, "features")
        grown = scored.withColumn("score", F.col("score") + F.lit(params.learning_rate) * value).select(*base.columns, "score")
        grown = checkpoint(grown) if (t + 1) % params.checkpoint_every == 0 else grown
        last, state = state, _judged(grown, params, t + 1).persist(StorageLevel.MEMORY_AND_DISK)
        seen = _measure(state, params, row_weight)
        if t == 0 and copied:
            base.unpersist()
        model.history.append((seen.loss.get(True, math.nan), seen.loss.get(False, seen.loss.get(True, math.nan))))
        improved = model.best_iteration == len(model.history)
        for old in {id(x): x for x in ((last, best) if improved else (last,)) if x is not best or improved}.values():
            old.unpersist()
        best = state if improved else best
        if len(model.history) - model.best_iteration >= params.patience:
            break
    model.scores = stored(best.select("uid", "y", "is_train", "score"), "scores")
    best.unpersist()
    state.unpersist()
    return model


def final_fit(rows: DataFrame, params: BoostParams) -> BoostModel:
    """Refit with the parameters found by the search."""
    return fit_newton_boost(rows, replace(params, seed=FINAL_SEED))


def predict_proba(models: dict[int, BoostModel], df: DataFrame, binomial: bool, features: str = "features") -> DataFrame:
    """Adds ``probs``, one entry per class, for every row of ``df``."""
    out = df
    for k, model in models.items():
        out = model.raw_score(out, f"_score_{k}", features)
    if binomial:
        one = focal.sigmoid(F.col("_score_1"))
        probs = F.array(1.0 - one, one)
    else:
        probs = F.array(*[focal.sigmoid(F.col(f"_score_{k}")) for k in sorted(models)])
    return out.withColumn("probs", probs).drop(*[f"_score_{k}" for k in models])


def state_proba(models: dict[int, BoostModel], people: DataFrame, binomial: bool) -> DataFrame:
    """``people`` (with uid) with ``probs``, one entry per class, from the scores that the fits carried along; no tree is applied."""
    if binomial:
        one = focal.sigmoid(F.col("score"))
        probs = models[1].scores.select("uid", F.array(1.0 - one, one).alias("probs"))
    else:
        long = [m.scores.select("uid", F.lit(k).alias("value"), focal.sigmoid(F.col("score")).alias("p")) for k, m in sorted(models.items())]
        both = long[0]
        for part in long[1:]:
            both = both.union(part)
        probs = both.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("value", "p"))), lambda x: x["p"]).alias("probs"))
    return people.join(probs, "uid")


def _nodes(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel]) -> DataFrame:
    """Nodes of all trees in one table: tree (its place in the list), split, gain, impurityStats and the other node columns."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    held = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    ones = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        held[i], ones[i] = tree._java_obj, 1.0
    ensemble = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel("trees", held, ones))
    path = new_folder(spark, "trees")
    ensemble.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")


def feature_importance(spark: SparkSession, models: dict[tuple[str, int], BoostModel], names: Sequence[str]) -> DataFrame:
    """Number of splits and total gain per model, class and feature, over the rounds in use.

    All trees are saved as one ensemble, so their nodes are one table of one write, and read back in one job.
    """
    trees, used, numbers = [], [], []
    for (attribute, k), model in models.items():
        on = model.params.features
        used.append((attribute, k, model.best_iteration, None if on is None else list(on)))
        for step in model.steps[: model.best_iteration]:
            numbers.append((len(trees), attribute, k, step.features))
            trees.append(step.tree)
    numbered = spark.createDataFrame(numbers, "tree int, attribute_model string, svkey_index int, entries array<int>")
    splits = (
        _nodes(spark, trees)
        .select(
            "tree", F.col("split.featureIndex").alias("position"),
            (F.col("gain") * F.col("impurityStats")[0]).alias("gain"),  # the first statistic is the node's weight
        )
        .where(F.col("position") >= 0)
        .join(numbered, "tree")
    )
    # a tree that saw only some entries counts positions among those
    named = splits.withColumn("idx", F.when(F.col("entries").isNull(), F.col("position")).otherwise(F.get("entries", F.col("position"))))
    sums = named.groupBy("attribute_model", "svkey_index", "idx").agg(F.count("gain").alias("split"), F.sum("gain").alias("gain"))
    features = spark.createDataFrame(list(enumerate(names)), "idx int, feature string")
    # one row per feature switched on, also where no split uses it
    on = F.coalesce("entries", F.sequence(F.lit(0), F.lit(len(names) - 1)))
    rows = spark.createDataFrame(
        used, "attribute_model string, svkey_index int, best_iteration int, entries array<int>"
    ).select("attribute_model", "svkey_index", "best_iteration", F.explode(on).alias("idx"))
    per_feature = (
        rows.join(features, "idx")
        .join(sums, ["attribute_model", "svkey_index", "idx"], "left")
        .select(
            "attribute_model", "svkey_index", "feature", "best_iteration",
            F.coalesce("split", F.lit(0)).cast("double").alias("split"), F.coalesce("gain", F.lit(0.0)).alias("gain"),
        )
    )
    return per_feature.unpivot(
        ["attribute_model", "svkey_index", "feature", "best_iteration"], ["split", "gain"], "importance_type", "importance"
    )


# ---- search and validation -------------------------------------------------------------------

# fixed values: search ranges (kind, low, high) of the boosting parameters
SPACE = {
    "learning_rate": ("uniform", 0.0001, 0.5),
    "max_delta_step": ("uniform", -1.0, 30.0),
    "num_leaves": ("even", 2, 4096),
    "max_depth": ("integer", 3, 11),
    "max_bins": ("integer", 2, 256),
    "min_data_in_leaf": ("integer", 1, 1024),
    "min_sum_hessian_in_leaf": ("lognormal", 3.0, 3.0),
    "min_gain_to_split": ("lognormal", 3.0, 3.0),
    "bagging_fraction": ("uniform", 0.0, 1.0),
    "feature_fraction": ("uniform", 0.0, 1.0),
    "lambda_l1": ("uniform", 1e-10, 20.0),
    "lambda_l2": ("uniform", 1e-10, 20.0),
    "top_rate": ("uniform", 0.0, 1.0),
    "other_rate": ("uniform", 0.0, 1.0),
    "gamma": ("uniform", 0.0001, 1.0),
    "alpha": ("uniform", 0.0001, 1.0),
    "use_alpha": ("choice", 0, 1),
}


def _draw(name: str, kind: str, low: float, high: float, seed: int, key: str) -> Column:
    unit = hash_uniform(F.col("trial"), name, seed, key)
    if kind == "uniform":
        return F.lit(low) + unit * (high - low)
    if kind == "integer":
        return (F.floor(unit * (high - low + 1)) + low).cast("double")
    if kind == "even":
        return (F.floor(unit * ((high - low) / 2 + 1)) * 2 + low).cast("double")
    if kind == "choice":
        return (unit < 0.5).cast("double")
    # lognormal: Box-Muller with a second draw
    other = hash_uniform(F.col("trial"), name, seed, key, "angle")
    normal = F.sqrt(-2.0 * F.log(1.0 - unit)) * F.cos(2.0 * math.pi * other)
    return F.exp(F.lit(low) + F.lit(high) * normal)


def trial_table(
    spark: SparkSession, n: int, features: Sequence[str], seed: int = SEARCH_SEED, space: dict | None = None, key: str = ""
) -> DataFrame:
    """One row per trial: a value for every range, and an on/off flag for every feature.

    ``key`` names what is searched for, such as a model and its class: each has draws of its own.
    """
    space = space if space is not None else SPACE
    on = F.transform(
        F.sequence(F.lit(0), F.lit(len(features) - 1)),
        lambda i: hash_uniform(F.col("trial"), i, "feature", seed, key) < 0.5,
    )
    columns = [_draw(name, *spec, seed, key).alias(name) for name, spec in space.items()]
    return spark.range(n).select(F.col("id").cast("int").alias("trial"), *columns, on.alias("feature_on"))


def params_of(row, base: BoostParams) -> BoostParams:
    """Boosting parameters of a trial row; what the row lacks stays as in ``base``."""
    given = row.asDict()
    kept = {}
    for name, value in given.items():
        if name in BoostParams.__dataclass_fields__ and name not in ("features", "alpha"):
            kept[name] = int(value) if name in ("num_leaves", "max_depth", "max_bins", "min_data_in_leaf") else float(value)
    if "other_rate" in kept:
        kept["other_rate"] = effective_other_rate(kept.get("top_rate", base.top_rate), kept["other_rate"])
    if "alpha" in given:
        kept["alpha"] = float(given["alpha"]) if given.get("use_alpha", 1.0) else None
    on = tuple(i for i, flag in enumerate(given.get("feature_on") or []) if flag)
    return replace(base, **kept, features=on or base.features)


def test_quality(model: BoostModel) -> tuple[float, float | None]:
    """(log loss, AUC) of the rows of the fit that were not trained on."""
    test = model.scores.where(~F.col("is_train")).select(F.lit("test").alias("set_uid"), F.col("y").cast("int").alias("y"), focal.sigmoid(F.col("score")).alias("p"))
    loss = osc.log_loss(test, ["set_uid"]).first()
    auc = osc.roc_auc(test, ["set_uid"]).first()
    return (loss.log_loss if loss else math.nan), (auc.roc_score if auc else None)


def constancy(model: BoostModel, rows: int = PENALTY_ROWS) -> float:
    """Penalty of a model that predicts few values: 1 - distinct predictions / rows, over a hash-chosen sample of respondents."""
    sample = random_sample(model.scores.select("uid", F.col("score").alias("p")), rows, ["uid"])
    found = osc.constant_prediction_penalty(sample, []).first()
    return float(found.penalty) if found and found.penalty is not None else 1.0


def qualities(models: dict[int, BoostModel], rows: int = PENALTY_ROWS) -> dict[int, tuple[float, float | None, float]]:
    """:func:`test_quality` and :func:`constancy` of several models of the same rows, in jobs for all of them instead of some for each.

    The models scored the same respondents, so the sample is drawn once.
    """
    if not models:
        return {}
    each = [m.scores.select(F.lit(trial).alias("trial"), "uid", "y", "is_train", "score") for trial, m in models.items()]
    scores = each[0]
    for part in each[1:]:
        scores = scores.union(part)
    test = scores.where(~F.col("is_train")).select("trial", F.col("y").cast("int").alias("y"), focal.sigmoid(F.col("score")).alias("p"))
    losses = {r.trial: r.log_loss for r in osc.log_loss(test, ["trial"]).collect()}
    areas = {r.trial: r.roc_score for r in osc.roc_auc(test, ["trial"]).collect()}
    sample = stored(random_sample(each[0].select("uid"), rows, ["uid"]).groupBy("uid").agg(F.count(F.lit(1)).alias("_times")), "sample")
    place = F.row_number().over(Window.partitionBy("trial", "uid").orderBy("score"))
    drawn = sample.withColumnRenamed("uid", "_uid")
    sampled = scores.join(drawn, F.col("uid").eqNullSafe(F.col("_uid"))).withColumn("_place", place).where("_place <= _times")
    penalties = {r.trial: r.penalty for r in osc.constant_prediction_penalty(sampled, ["trial"], "score").collect()}
    return {k: (losses.get(k, math.nan), areas.get(k), penalties.get(k, 1.0)) for k in models}


@dataclass
class SearchResult:
    trials: DataFrame
    params: BoostParams
    loss: float
    log_loss: float
    roc_score: float | None
    retried: bool


def random_search(
    rows: DataFrame, features: Sequence[str], n: int, base: BoostParams, seed: int = SEARCH_SEED, space: dict | None = None,
    threads: int = 4, key: str = "",
) -> SearchResult:
    """Fit every trial on the train rows, keep the one with the least loss.

    The loss of a trial is the log loss of the test rows plus the penalty for few distinct predictions. A trial
    whose AUC is exactly one half predicts nothing and has failed, and so has one whose sample of rows is
    empty; when all fail the best of all is taken and ``retried`` is set.
    """
    spark = rows.sparkSession
    table = trial_table(spark, n, features, seed, space, key)
    drawn = table.collect()

    def run(row):
        try:
            return fit_newton_boost(rows, params_of(row, base))
        except NoRows:
            return None

    fitted = dict(zip([row.trial for row in drawn], in_parallel([lambda row=row: run(row) for row in drawn], threads)))
    found = qualities({trial: model for trial, model in fitted.items() if model is not None})
    results = []
    for trial in fitted:
        if trial not in found:
            results.append((trial, math.inf, math.inf, None, 1.0, True))
            continue
        log_loss, auc, penalty = found[trial]
        results.append((trial, float(log_loss) + penalty, float(log_loss), None if auc is None else float(auc), penalty, auc == 0.5))
    usable = [r for r in results if not r[-1]]
    chosen = min(usable or results, key=lambda r: (r[1], r[0]))
    outcome = spark.createDataFrame(results, "trial int, loss double, log_loss double, roc_score double, random_score double, failed boolean")
    return SearchResult(table.join(outcome, "trial"), params_of(drawn[chosen[0]], base), *chosen[1:4], not usable)


def search_log(trials: DataFrame, model: str) -> DataFrame:
    """One row per trial and parameter setting, tagged with the model."""
    return trials.select(F.lit(model).alias("model"), *[c for c in trials.columns if c != "feature_on"], F.array_size(F.filter("feature_on", lambda x: x)).alias("n_features"))


def cross_validate(rows: DataFrame, params: BoostParams, k: int = 5, seed: int = 0, threads: int = 4) -> DataFrame:
    """Stratified k-fold: mean and standard deviation of the held-out loss per round, best round marked.

    ``rows`` has (uid, features, y).
    """
    folded = stratified_folds(rows, [], k, seed, label="y").persist(StorageLevel.MEMORY_AND_DISK)

    def run(fold):
        model = fit_newton_boost(folded.withColumn("is_train", F.col("fold") != fold), replace(params, patience=params.rounds))
        return [(fold, i + 1, test) for i, (_, test) in enumerate(model.history)]

    losses = [r for part in in_parallel([lambda f=f: run(f) for f in range(k)], threads) for r in part]
    folded.unpersist()
    table = rows.sparkSession.createDataFrame(losses, "fold int, iteration int, loss double")
    summary = table.groupBy("iteration").agg(
        F.avg("loss").alias("mean_loss"), F.stddev_pop("loss").alias("sd_loss"), F.count("loss").alias("folds")
    )
    best = summary.select(F.min(F.struct("mean_loss", "iteration")).alias("b")).select("b.iteration").scalar()
    return summary.withColumn("best", F.col("iteration") == best)
