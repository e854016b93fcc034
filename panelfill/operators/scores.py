"""Quality of scores: AUC, log loss, ROC points, best threshold, metric tables.

Scores are counted per distinct value first. All cumulative work runs on those counts with
:mod:`panelfill.operators.running`, so a model with very many scores is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.functions.focal import clip_probability
from panelfill.functions.survey import is_binomial, ratio, slice_set, slice_value
from panelfill.operators.joins import with_answer_codes
from panelfill.operators.running import range_buckets, running_totals

GROUP = ["attribute_model", "value", "set_uid"]


def class_scores(results: DataFrame) -> DataFrame:
    """One row per respondent and class of the labelled rows: y (0/1) against p.

    A binomial model has one scored class, the positive one.
    """
    long = results.where(F.col("label").isNotNull()).select(
        "uid", "attribute_model", "set_uid", "label", F.posexplode("probs").alias("value", "p")
    )
    scored = ~is_binomial(F.col("attribute_model")) | (F.col("value") == 1)
    return long.where(scored).withColumn("y", (F.col("label") == F.col("value")).cast("int"))


def score_counts(scores: DataFrame, group: Sequence[str] = GROUP, score: str = "p") -> DataFrame:
    return scores.groupBy(*group, score).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def _cumulated(scores: DataFrame, group: Sequence[str], score: str, buckets: int | None) -> DataFrame:
    return running_totals(
        range_buckets(score_counts(scores, group, score), score, buckets), group, [score], {"pos": "pos_below", "neg": "neg_below"}
    )


def roc_auc(scores: DataFrame, group: Sequence[str] = GROUP, score: str = "p", buckets: int | None = None) -> DataFrame:
    """Chance that a positive row outranks a negative one; ties count half. Null without both kinds."""
    ranked = _cumulated(scores, group, score, buckets)
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0)
    return ranked.groupBy(*group).agg(
        ratio(F.sum(wins), F.max("all_pos").cast("double") * F.max("all_neg")).alias("roc_score")
    )


def log_loss(scores: DataFrame, group: Sequence[str] = GROUP, score: str = "p") -> DataFrame:
    p = clip_probability(F.col(score))
    return scores.groupBy(*group).agg(
        F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1.0 - p))).alias("log_loss")
    )


def roc_curve(scores: DataFrame, group: Sequence[str] = GROUP, score: str = "p", buckets: int | None = None) -> DataFrame:
    """Rates at each distinct score taken as threshold (score >= threshold is positive).

    Each group starts with a threshold above its highest score, where nothing is positive.
    """
    ranked = _cumulated(scores, group, score, buckets)
    tp = (F.col("all_pos") - F.col("pos_below")).cast("double")
    fp = (F.col("all_neg") - F.col("neg_below")).cast("double")
    points = ranked.select(
        *group, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        F.col("all_pos").cast("double").alias("positives"), F.col("all_neg").cast("double").alias("negatives"),
    )
    start = points.groupBy(*group).agg(
        (F.max("threshold") + 1.0).alias("threshold"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"),
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
    )
    return points.unionByName(start).withColumns(
        {"tpr": ratio(F.col("tp"), F.col("positives")), "fpr": ratio(F.col("fp"), F.col("negatives"))}
    )


def best_youden_threshold(curve: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Threshold with the largest tpr - fpr, the largest one on ties."""
    gap = F.round(F.col("tpr") - F.col("fpr"), 9)
    return curve.groupBy(*group).agg(F.max(F.struct(gap.alias("youden"), "threshold")).alias("b")).select(
        *group, "b.threshold", "b.youden"
    )


def best_mcc_threshold(curve: DataFrame, group: Sequence[str] = ("attribute_model", "value")) -> DataFrame:
    """Threshold with the highest Matthews correlation, the largest one on ties."""
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp
    scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(scale == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / F.when(scale == 0, F.lit(1.0)).otherwise(scale))
    return curve.groupBy(*group).agg(F.max(F.struct(F.round(mcc, 9).alias("mcc"), "threshold")).alias("b")).select(
        *group, "b.threshold", "b.mcc"
    )


def metrics_table(results: DataFrame, trials: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """AUC and log loss per model, class and split; best search trials come in as split ``hyperopt``.

    ``trials`` has (attribute_model, value, log_loss, roc_score).
    """
    scores = class_scores(results)
    both = roc_auc(scores, buckets=buckets).join(log_loss(scores), GROUP)
    if trials is not None:
        both = both.unionByName(trials.withColumn("set_uid", F.lit("hyperopt")).select(*both.columns))
    return both.select(
        F.concat_ws("_", "value", "set_uid").alias("data_slice"), "log_loss", "roc_score", F.col("attribute_model").alias("model")
    )


def metrics_report(metrics: DataFrame, codes: DataFrame, round_number: int) -> DataFrame:
    """Metrics with question and answer keys, set name and round."""
    parsed = metrics.withColumns({"value": slice_value(F.col("data_slice")), "set": slice_set(F.col("data_slice"))})
    return (
        with_answer_codes(parsed, codes, model="model", value="value")
        .select("attribute", "sakey", "svkey", "multi", "set", "log_loss", "roc_score")
        .withColumn("round", F.lit(round_number))
    )


def round_pairs(newer: DataFrame, older: DataFrame) -> DataFrame:
    """AUC of two rounds side by side, per attribute, answer and set."""
    keys = ["attribute", "svkey", "set"]
    return newer.select(*keys, F.col("roc_score").alias("roc1")).join(
        older.select(*keys, F.col("roc_score").alias("roc0")), keys
    ).withColumn("roc_ratio", ratio(F.col("roc1"), F.col("roc0")))


def round_drift(newer: DataFrame, older: DataFrame) -> DataFrame:
    return round_pairs(newer, older).groupBy("set").agg(F.avg("roc_ratio").alias("mean_roc_ratio"))


def constant_prediction_penalty(scores: DataFrame, group: Sequence[str], score: str = "p") -> DataFrame:
    """1 - distinct scores / rows: near 1 for a model that predicts a constant.

    Distinct values come from a grouping on (group, score), so no task holds a whole group.
    """
    per_score = scores.groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"))
    return per_score.groupBy(*group).agg(
        (1.0 - F.count(F.lit(1)) / F.sum("n")).alias("penalty")
    )
