"""Queries for statistics, model preparation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.catalog.aggregates import classes_of
from panelfill.catalog.base import predictions_of, query, r6, u
from panelfill.functions import focal
from panelfill.functions import survey as fs
from panelfill.operators import association as oa
from panelfill.operators import boosting as ob
from panelfill.operators import calibration as ocal
from panelfill.operators import scores as osc
from panelfill.operators import shares as osh
from panelfill.operators.bootstrap import bootstrap_share_bounds
from panelfill.session import stored
from panelfill.sources.survey import MODELS

REPS = 1000
EVALS = 20
G3 = "attribute_model, value, set_uid"
LATENT = ("ld_0", "ld_1", "ld_2", "ld_3")


def labeled(s):
    """Observed labels with weights, as a round keeps them beside its scores."""
    return s.scores.where(F.col("label").isNotNull()).select("uid", "wavekey", "attribute_model", "label", "weight")


def bounds(s):
    return bootstrap_share_bounds(labeled(s), classes_of(s), REPS)


@query(
    "f1_bootstrap_share_bounds",
    """SELECT attribute_model, value, round(lower_bound_distribution, 6) AS lower, round(upper_bound_distribution, 6) AS upper,
              round(simulation_distribution, 6) AS mean FROM bounds""",
)
def f1(s):
    return bounds(s).select(
        "attribute_model", "value", r6("lower_bound_distribution", "lower"), r6("upper_bound_distribution", "upper"),
        r6("simulation_distribution", "mean"),
    )


def long_features(s):
    """Observed labels and the non-negative latent values as one long table."""
    answers = s.labels.select("uid", F.col("attribute").alias("feature"), F.col("label").cast("double").alias("value"))
    latent = s.latent.unpivot(["uid"], list(LATENT), "feature", "value").where(F.col("value").isNotNull())
    return answers.unionByName(latent)


FEATURES = """(SELECT uid, attribute AS feature, CAST(label AS DOUBLE) AS value FROM coded_labels
     UNION ALL SELECT uid, 'ld_0', ld_0 FROM latent WHERE ld_0 IS NOT NULL
     UNION ALL SELECT uid, 'ld_1', ld_1 FROM latent WHERE ld_1 IS NOT NULL
     UNION ALL SELECT uid, 'ld_2', ld_2 FROM latent WHERE ld_2 IS NOT NULL
     UNION ALL SELECT uid, 'ld_3', ld_3 FROM latent WHERE ld_3 IS NOT NULL)"""


def chi2_sql(targets: str) -> str:
    return f"""(SELECT t.attribute_model, t.feature, count(*) - 1 AS df, sum((coalesce(o.observed, 0) - p.prior * t.total) ** 2 / nullif(p.prior * t.total, 0)) AS chi2
        FROM (SELECT y.attribute_model, f.feature, sum(f.value) AS total FROM {FEATURES} f JOIN {targets} y ON y.uid = f.uid GROUP BY ALL) t
        JOIN (SELECT attribute_model, label, n / sum(n) OVER (PARTITION BY attribute_model) AS prior
              FROM (SELECT attribute_model, label, count(*) AS n FROM {targets} GROUP BY ALL)) p ON p.attribute_model = t.attribute_model
        LEFT JOIN (SELECT y.attribute_model, f.feature, y.label, sum(f.value) AS observed FROM {FEATURES} f JOIN {targets} y ON y.uid = f.uid GROUP BY ALL) o
          ON o.attribute_model = t.attribute_model AND o.feature = t.feature AND o.label = p.label
        GROUP BY t.attribute_model, t.feature)"""


OBSERVED = "(SELECT uid, attribute AS attribute_model, label FROM coded_labels WHERE attribute IN (SELECT attribute_model FROM model_sizes))"
FINAL = "(SELECT uid, attribute_model, selected_value AS label FROM predictions)"

# upper tail of chi-square for 1 to 4 degrees of freedom: closed forms, and the series of the error function with positive terms
_x = "(chi2 / 2)"
_erfc = f"""(CASE WHEN {_x} > 30 THEN 0 WHEN {_x} <= 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-{_x}) * list_sum(list_transform(range(0, 300),
    lambda n: exp(2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(sqrt({_x})) + lgamma(n + 1.0::DOUBLE) - lgamma(2 * n + 2.0::DOUBLE)))) END)"""
P_VALUE = f"""round(CASE df WHEN 1 THEN {_erfc} WHEN 2 THEN exp(-{_x}) WHEN 3 THEN {_erfc} + 2 * sqrt({_x} / pi()) * exp(-{_x})
    WHEN 4 THEN exp(-{_x}) * (1 + {_x}) END, 6) AS p_value"""


def targets(s):
    return s.labels.where(F.col("attribute").isin(list(MODELS))).select("uid", F.col("attribute").alias("attribute_model"), "label")


@query("f2_chi2_scores", f"SELECT attribute_model, feature, round(chi2, 4) AS chi2, {P_VALUE} FROM {chi2_sql(OBSERVED)}")
def f2(s):
    return oa.chi2_scores(long_features(s), targets(s)).select("attribute_model", "feature", F.round("chi2", 4).alias("chi2"), r6("p_value"))


@query(
    "f3_chi2_before_after",
    f"""SELECT 'preImputation' AS phase, attribute_model, feature, round(chi2, 4) AS chi2, {P_VALUE} FROM {chi2_sql(OBSERVED)}
        UNION ALL SELECT 'postImputation', attribute_model, feature, round(chi2, 4), {P_VALUE} FROM {chi2_sql(FINAL)}""",
)
def f3(s):
    final = predictions_of(s).select("uid", "attribute_model", F.col("selected_value").alias("label"))
    return oa.chi2_before_after(long_features(s), targets(s), final).select(
        "phase", "attribute_model", "feature", F.round("chi2", 4).alias("chi2"), r6("p_value")
    )


@query(
    "f4_chi2_with_taxonomy",
    f"""SELECT c.attribute_model, c.feature, round(c.chi2, 4) AS chi2, c.p_value, t.sakey, t.svkey, t.is_display_logic_sakey, t.min_level, t.proposed_round
        FROM (SELECT *, {P_VALUE} FROM {chi2_sql(OBSERVED)}) c JOIN taxonomy t ON t.attribute = c.feature""",
)
def f4(s):
    return oa.chi2_with_taxonomy(oa.chi2_scores(long_features(s), targets(s)), s.taxonomy).select(
        "attribute_model", "feature", F.round("chi2", 4).alias("chi2"), r6("p_value"), "sakey", "svkey", "is_display_logic_sakey", "min_level", "proposed_round"
    )


def latent_with_flag(s):
    """Latent values in long form, flagged by whether the respondent answered question 102."""
    answered = s.labels.where(F.col("attribute") == "102").select("uid", F.lit(True).alias("answered"))
    long = s.latent.unpivot(["uid"], ["ld_0", "ld_1", "ld_2", "ld_3"], "feature", "value")
    return long.join(answered, "uid", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def ks_sql(rows: str) -> str:
    """KS statistic, sizes and asymptotic p-value per group of (feature, value, flag)."""
    return f"""(SELECT *, CASE WHEN t < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
              lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * t * t))))) END AS p_value
       FROM (SELECT *, statistic * sqrt(CAST(n1 AS DOUBLE) * n0 / (n1 + n0)) AS t
       FROM (SELECT feature, max(abs(f1 - f0)) AS statistic, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n0) AS BIGINT) AS n0
       FROM (SELECT feature, sum(c1) OVER w / nullif(sum(c1) OVER (PARTITION BY feature), 0) AS f1, sum(c0) OVER w / nullif(sum(c0) OVER (PARTITION BY feature), 0) AS f0,
                    sum(c1) OVER (PARTITION BY feature) AS n1, sum(c0) OVER (PARTITION BY feature) AS n0
             FROM (SELECT feature, value, sum(flag) AS c1, sum(1 - flag) AS c0 FROM {rows} GROUP BY feature, value)
             WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY feature)))"""


LATENT_FLAGGED = """(SELECT f.feature, f.value, CAST(m.uid IS NOT NULL AS INTEGER) AS flag
         FROM (SELECT uid, 'ld_0' AS feature, ld_0 AS value FROM latent UNION ALL SELECT uid, 'ld_1', ld_1 FROM latent
               UNION ALL SELECT uid, 'ld_2', ld_2 FROM latent UNION ALL SELECT uid, 'ld_3', ld_3 FROM latent) f
         LEFT JOIN (SELECT uid FROM matrix WHERE attribute = '102') m ON m.uid = f.uid WHERE f.value IS NOT NULL)"""
KS_LATENT = ks_sql(LATENT_FLAGGED)


@query("f5_ks_two_sample", f"SELECT feature, round(statistic, 6) AS statistic, n1, n0, round(p_value, 6) AS p_value FROM {KS_LATENT}")
def f5(s):
    return oa.ks_two_sample(latent_with_flag(s), "value", "answered", ["feature"]).select("feature", r6("statistic"), "n1", "n0", r6("p_value"))


SCORES_FLAGGED = """(SELECT s.attribute_model || ':' || k.value AS feature, s.probs[k.value + 1] AS value, CAST(s.label IS NULL AS INTEGER) AS flag
         FROM scores s JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS value) k ON k.value < s.num_class
         WHERE s.label IS NULL OR s.set_uid = 'validation')"""


@query(
    "f5_ks_predicted_scores",
    f"SELECT feature, round(statistic, 6) AS statistic, n1, n0, round(p_value, 6) AS p_value FROM {ks_sql(SCORES_FLAGGED)} WHERE statistic IS NOT NULL",
)
def f5_scores(s):
    """Scores of each class: unlabelled respondents against labelled ones of the validation split."""
    kept = s.scores.where(F.col("label").isNull() | (F.col("set_uid") == "validation"))
    long = kept.select("attribute_model", F.col("label").isNull().alias("open"), F.posexplode("probs").alias("value", "p"))
    long = long.withColumn("feature", F.concat_ws(":", "attribute_model", "value"))
    return oa.ks_two_sample(long, "p", "open", ["feature"]).where("statistic IS NOT NULL").select("feature", r6("statistic"), "n1", "n0", r6("p_value"))


@query(
    "e10_top_k",
    f"""SELECT feature, CAST(rank AS INTEGER) AS rank, round(p_value, 6) AS p_value FROM (
          SELECT *, row_number() OVER (ORDER BY p_value DESC, statistic, feature) AS rank FROM {KS_LATENT}) WHERE rank <= 250""",
)
def e10(s):
    """The 250 latent columns that tell respondents with an answer to 102 from the others least."""
    ks = oa.ks_two_sample(latent_with_flag(s), "value", "answered", ["feature"])
    return oa.closest_features(ks, 250).select("feature", "rank", r6("p_value"))


@query("f6_roc_auc", f"SELECT {G3}, round(roc_score, 6) AS roc_score FROM auc")
def f6(s):
    return osc.roc_auc(osc.class_scores(s.scores)).withColumn("roc_score", r6("roc_score"))


@query("f7_log_loss", f"SELECT {G3}, round(log_loss, 6) AS log_loss FROM losses")
def f7(s):
    return osc.log_loss(osc.class_scores(s.scores)).withColumn("log_loss", r6("log_loss"))


@query(
    "f8_roc_curve",
    f"SELECT {G3}, round(threshold, 6) AS threshold, round(tp / positives, 6) AS tpr, round(fp / negatives, 6) AS fpr FROM curve",
)
def f8(s):
    return osc.roc_curve(osc.class_scores(s.scores)).select(
        *osc.GROUP, r6("threshold"), r6("tpr"), r6("fpr")
    )


@query(
    "f8_best_youden_threshold",
    f"""SELECT {G3}, round(threshold, 6) AS threshold, round(youden, 6) AS youden
        FROM (SELECT *, row_number() OVER (PARTITION BY {G3} ORDER BY youden DESC, threshold DESC) AS i
              FROM (SELECT *, round(tp / positives - fp / negatives, 9) AS youden FROM curve)) WHERE i = 1""",
)
def f8_best(s):
    return osc.best_youden_threshold(osc.roc_curve(osc.class_scores(s.scores))).select(*osc.GROUP, r6("threshold"), r6("youden"))


@query(
    "f9_best_mcc_threshold",
    """SELECT attribute_model, value, round(threshold, 6) AS threshold, round(mcc, 6) AS mcc
       FROM (SELECT *, row_number() OVER (PARTITION BY attribute_model, value ORDER BY mcc DESC, threshold DESC) AS i
             FROM (SELECT attribute_model, value, threshold,
                          round(coalesce((tp * (negatives - fp) - fp * (positives - tp))
                                / nullif(sqrt((tp + fp) * positives * negatives * (negatives - fp + positives - tp)), 0), 0), 9) AS mcc
                   FROM curve WHERE set_uid = 'test')) WHERE i = 1""",
)
def f9(s):
    """The threshold is chosen on the test split."""
    test = osc.class_scores(s.scores).where(F.col("set_uid") == "test")
    return osc.best_mcc_threshold(osc.roc_curve(test)).select("attribute_model", "value", r6("threshold"), r6("mcc"))


@query("f10_argmax_class", "SELECT uid, attribute_model, max_prediction AS winner FROM predictions")
def f10(s):
    return s.scores.select("uid", "attribute_model", fs.argmax_class(F.col("probs")).alias("winner"))


@query(
    "f11_quantiles",
    """SELECT wavekey, round(quantile_cont(w, 0.025), 6) AS q2_5, round(quantile_cont(w, 0.5), 6) AS q50, round(quantile_cont(w, 0.975), 6) AS q97_5
       FROM (SELECT wavekey, CAST(respondentweight AS DOUBLE) AS w FROM respondents) GROUP BY wavekey""",
)
def f11(s):
    rows = s.respondents.select("wavekey", F.col("respondentweight").cast("double").alias("w"))
    q = oa.exact_quantiles(rows, "w", ["wavekey"], [0.025, 0.5, 0.975])
    return q.select("wavekey", r6("q2_5"), r6("q50"), r6("q97_5"))


TRIALS = "SELECT attribute_model, value, 'hyperopt' AS set_uid, min(log_loss) AS log_loss, max(roc_score) AS roc_score FROM losses JOIN auc USING (attribute_model, value, set_uid) GROUP BY attribute_model, value"


@query(
    "f12_metrics_table",
    f"""SELECT value || '_' || set_uid AS data_slice, attribute_model AS model, round(log_loss, 6) AS log_loss, round(roc_score, 6) AS roc_score
        FROM (SELECT attribute_model, value, set_uid, log_loss, roc_score FROM losses JOIN auc USING (attribute_model, value, set_uid)
              UNION ALL {TRIALS})""",
)
def f12(s):
    scores = osc.class_scores(s.scores)
    both = osc.roc_auc(scores).join(osc.log_loss(scores), osc.GROUP)
    trials = both.groupBy("attribute_model", "value").agg(F.min("log_loss").alias("log_loss"), F.max("roc_score").alias("roc_score"))
    return osc.metrics_table(s.scores, trials).select("data_slice", "model", r6("log_loss"), r6("roc_score"))


@query(
    "f13_metrics_report",
    """SELECT c.attribute, c.sakey, c.svkey, c.multi, l.set_uid AS "set", round(l.log_loss, 6) AS log_loss, round(a.roc_score, 6) AS roc_score, 1 AS round
       FROM losses l JOIN auc a USING (attribute_model, value, set_uid)
       JOIN answer_codes c ON c.attribute = l.attribute_model AND c.attribute_value = l.value""",
)
def f13(s):
    return osc.metrics_report(osc.metrics_table(s.scores), s.answer_codes, 1).select(
        "attribute", "sakey", "svkey", "multi", "set", r6("log_loss"), r6("roc_score"), "round"
    )


# ---- model preparation -----------------------------------------------------------------------


@query(
    "g1_split_masks",
    """SELECT attribute_model, set_uid, label, count(*) AS n, round(sum(weight), 2) AS weight
       FROM scores WHERE label IS NOT NULL GROUP BY attribute_model, set_uid, label""",
)
def g1(s):
    parts = [ob.split_rows(s.scores, name) for name in ob.SPLITS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("attribute_model", "set_uid", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


@query("g2_one_vs_rest", f"SELECT {G3}, count(*) AS n, CAST(sum(y) AS DOUBLE) AS positives FROM class_scores GROUP BY {G3}")
def g2(s):
    long = ob.one_vs_rest(s.scores.where(F.col("label").isNotNull()))
    return long.groupBy("attribute_model", "value", "set_uid").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


_q = "(CASE WHEN y = 1 THEN p ELSE 1 - p END)"
_a = "(CASE WHEN y = 1 THEN 0.4::DOUBLE ELSE 1 - 0.4::DOUBLE END)"
_v = f"(0.7::DOUBLE * {_q} * ln({_q}) + {_q} - 1)"


@query(
    "g4_focal_loss_and_derivatives",
    f"""SELECT {G3}, round(avg(-{_a} * (1 - {_q}) ** 0.7::DOUBLE * ln({_q})), 6) AS loss,
               round(avg({_a} * (2 * y - 1) * (1 - {_q}) ** 0.7::DOUBLE * {_v}), 6) AS grad,
               round(avg({_a} * ((1 - {_q}) ** 0.7::DOUBLE * (0.7::DOUBLE * ln({_q}) + 1.7::DOUBLE) - 0.7::DOUBLE * (1 - {_q}) ** (-0.3::DOUBLE) * {_v}) * {_q} * (1 - {_q})), 6) AS hess
        FROM class_scores GROUP BY {G3}""",
)
def g4(s):
    y, p = F.col("y"), F.col("p")
    return osc.class_scores(s.scores).groupBy(*osc.GROUP).agg(
        r6(F.avg(focal.focal_loss(y, p, 0.7, 0.4)), "loss"),
        r6(F.avg(focal.focal_grad(y, p, 0.7, 0.4)), "grad"),
        r6(F.avg(focal.focal_hess(y, p, 0.7, 0.4)), "hess"),
    )


@query(
    "g5_focal_init_score",
    "SELECT attribute_model, value, round(ln(sum(y) / sum(1 - y)), 6) AS init_score FROM class_scores WHERE set_uid = 'train' GROUP BY attribute_model, value",
)
def g5(s):
    train = osc.class_scores(ob.split_rows(s.scores, "train"))
    return ob.init_scores(train, ["attribute_model", "value"], gamma=0.0).select("attribute_model", "value", r6("init_score"))


@query("g5_focal_init_score_focused")
def g5_focused(s):
    train = osc.class_scores(ob.split_rows(s.scores, "train"))
    return ob.init_scores(train, ["attribute_model", "value"], gamma=0.8, alpha=0.3)


@query(
    "g12_stratified_folds",
    f"""SELECT uid, attribute_model, (row_number() OVER (PARTITION BY attribute_model, label ORDER BY {u('uid', 'attribute_model', '5')}, uid) - 1) % 5 AS fold
        FROM scores WHERE label IS NOT NULL""",
)
def g12(s):
    rows = s.scores.where(F.col("label").isNotNull()).select("uid", "attribute_model", "label")
    return ob.stratified_folds(rows, ["attribute_model"], k=5, seed=5).select("uid", "attribute_model", "fold")


@query(
    "g13_class_weights",
    """SELECT c.attribute_model, c.uid, round(w.w / max(w.w) OVER (PARTITION BY c.attribute_model), 6) AS class_weight
       FROM (SELECT uid, attribute_model, label FROM scores WHERE label IS NOT NULL) c
       JOIN (SELECT attribute_model, label, sum(count(*)) OVER (PARTITION BY attribute_model) / count(*) AS w
             FROM scores WHERE label IS NOT NULL GROUP BY attribute_model, label) w
         ON w.attribute_model = c.attribute_model AND w.label = c.label""",
)
def g13(s):
    """Classes weighed by the inverse of their size."""
    rows = s.scores.where(F.col("label").isNotNull()).select("uid", "attribute_model", "label")
    sizes = rows.groupBy("attribute_model", "label").agg(F.count(F.lit(1)).alias("n"))
    all_rows = sizes.groupBy("attribute_model").agg(F.sum("n").alias("n_all"))
    weights = sizes.join(all_rows, "attribute_model").select("attribute_model", "label", (F.col("n_all") / F.col("n")).alias("weight"))
    return ob.class_weights(rows, weights, ["attribute_model"]).select("uid", "attribute_model", r6("class_weight"))


@query("g15_observed_wins", "SELECT uid, attribute_model, selected_value FROM predictions")
def g15(s):
    return s.scores.select(
        "uid", "attribute_model", fs.observed_wins(F.col("label"), fs.argmax_class(F.col("probs"))).alias("selected_value")
    )


# ---- calibration -----------------------------------------------------------------------------

CANDIDATES = f"""(SELECT s.attribute_model, s.wavekey, s.num_class, c.candidate, list_transform(range(0, s.num_class),
            lambda k: 1.0::DOUBLE / (1e-10::DOUBLE + (1.0::DOUBLE - 1e-10::DOUBLE) * {u('s.attribute_model', 's.wavekey', 'c.candidate', 'k', '0')})) AS m
        FROM (SELECT DISTINCT attribute_model, wavekey, num_class FROM scores) s
        JOIN (SELECT CAST(unnest(range(0, {EVALS} * 5)) AS INTEGER) AS candidate) c ON c.candidate < {EVALS} * s.num_class)"""

WON = f"""(SELECT attribute_model, wavekey, candidate, num_class, label, weight, probs, list_position(sm, list_max(sm)) - 1 AS winner
        FROM (SELECT s.*, c.candidate, list_transform(range(1, s.num_class + 1), lambda i: s.probs[i] * c.m[i]) AS sm
              FROM scores s JOIN {CANDIDATES} c ON c.attribute_model = s.attribute_model AND c.wavekey = s.wavekey))"""

LOSSES = f"""(WITH won AS (SELECT * FROM {WON}),
        agg AS (SELECT attribute_model, wavekey, candidate, sum(1 - probs[winner + 1] / list_max(probs)) / count(*) AS prob_loss, sum(weight) AS total,
                       count(*) - count(label) AS n_missing, max(num_class) AS num_class FROM won GROUP BY ALL),
        cells AS (SELECT attribute_model, wavekey, candidate, coalesce(label, winner) AS value, sum(weight) AS w FROM won GROUP BY ALL)
        SELECT a.attribute_model, a.wavekey, a.candidate, max(a.prob_loss) AS prob_loss,
               sum((b.simulation_distribution - coalesce(c.w, 0) / a.total) ** 2) AS distribution_error,
               1 - avg(CASE WHEN coalesce(c.w, 0) / a.total BETWEEN b.lower_bound_distribution AND b.upper_bound_distribution THEN 1 ELSE 0 END) AS confidence_interval_error
        FROM agg a JOIN bounds b ON b.attribute_model = a.attribute_model
        LEFT JOIN cells c ON c.attribute_model = a.attribute_model AND c.wavekey = a.wavekey AND c.candidate = a.candidate AND c.value = b.value
        WHERE a.n_missing > 0 GROUP BY a.attribute_model, a.wavekey, a.candidate)"""

BEST = f"""(SELECT attribute_model, wavekey, candidate, loss FROM (
            SELECT *, row_number() OVER (PARTITION BY attribute_model, wavekey ORDER BY loss, candidate) AS i
            FROM (SELECT *, round(distribution_error + prob_loss + confidence_interval_error, 9) AS loss FROM {LOSSES})) WHERE i = 1)"""


def score_cells(s):
    return s.scores.select("attribute_model", "wavekey", "num_class").distinct()


@query(
    "h1_threshold_candidates",
    f"SELECT attribute_model, wavekey, candidate, CAST(unnest(range(0, num_class)) AS INTEGER) AS value, unnest(list_transform(m, lambda x: round(1 / x, 9))) AS u FROM {CANDIDATES}",
)
def h1(s):
    return ocal.threshold_candidates(score_cells(s), EVALS).select(
        "attribute_model", "wavekey", "candidate", F.posexplode("multipliers").alias("value", "m")
    ).select("attribute_model", "wavekey", "candidate", "value", F.round(1.0 / F.col("m"), 9).alias("u"))


@query("h2_apply_multipliers", f"SELECT attribute_model, wavekey, winner, count(*) AS n FROM {WON} WHERE candidate = 0 GROUP BY attribute_model, wavekey, winner")
def h2(s):
    first = stored(ocal.threshold_candidates(score_cells(s), 1).where(F.col("candidate") == 0), "candidates")
    rows = s.scores.join(first.drop("num_class", "candidate"), ocal.CELL)
    return rows.groupBy(
        *ocal.CELL, fs.apply_multipliers(F.col("probs"), F.col("multipliers")).alias("winner")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h3_calibration_loss",
    f"""SELECT attribute_model, wavekey, candidate, round(distribution_error, 6) AS distribution_error, round(prob_loss, 6) AS prob_loss,
               round(confidence_interval_error, 6) AS confidence_interval_error,
               round(distribution_error + prob_loss + confidence_interval_error, 6) AS loss FROM {LOSSES}""",
)
def h3(s):
    losses = ocal.calibration_losses(s.scores, bounds(s), EVALS)
    return losses.select(
        *ocal.CELL, "candidate",
        *[r6(c) for c in ("distribution_error", "prob_loss", "confidence_interval_error", "loss")],
    )


@query("h4_calibrate_waves", f"SELECT attribute_model, wavekey, candidate, round(loss, 6) AS loss FROM {BEST}")
def h4(s):
    return ocal.calibrate_waves(s.scores, bounds(s), EVALS).select(
        *ocal.CELL, "candidate", r6("loss")
    )


FINAL_VALUES = f"""(SELECT s.uid, s.attribute_model, s.wavekey, s.num_class, s.weight, coalesce(s.label, w.winner) AS selected_value
        FROM scores s LEFT JOIN (SELECT s.uid, s.attribute_model, list_position(sm, list_max(sm)) - 1 AS winner
              FROM (SELECT s.uid, s.attribute_model, list_transform(range(1, s.num_class + 1), lambda i: s.probs[i] * c.m[i]) AS sm
                    FROM scores s JOIN {CANDIDATES} c ON c.attribute_model = s.attribute_model AND c.wavekey = s.wavekey
                    JOIN {BEST} b ON b.attribute_model = c.attribute_model AND b.wavekey = c.wavekey AND b.candidate = c.candidate) s) w
          ON w.uid = s.uid AND w.attribute_model = s.attribute_model)"""


@query(
    "h5_wave_distribution_report",
    f"""WITH fin AS (SELECT * FROM {FINAL_VALUES}),
        tot AS (SELECT attribute_model, wavekey, max(num_class) AS k, sum(weight) AS total FROM fin GROUP BY ALL),
        hist AS (SELECT t.attribute_model, t.wavekey, v.value, coalesce(c.w, 0) / t.total AS share
                 FROM tot t JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS value) v ON v.value < t.k
                 LEFT JOIN (SELECT attribute_model, wavekey, selected_value, sum(weight) AS w FROM fin GROUP BY ALL) c
                   ON c.attribute_model = t.attribute_model AND c.wavekey = t.wavekey AND c.selected_value = v.value)
        SELECT h.attribute_model AS attribute, h.wavekey, h.value, round(h.share, 6) AS share,
               round(avg(h.share) OVER (PARTITION BY h.attribute_model, h.value), 6) AS imputed_distribution,
               round(b.simulation_distribution, 6) AS simulation_distribution, round(b.lower_bound_distribution, 6) AS lower_bound_distribution,
               round(b.upper_bound_distribution, 6) AS upper_bound_distribution, c.sakey, c.svkey
        FROM hist h JOIN bounds b ON b.attribute_model = h.attribute_model AND b.value = h.value
        JOIN answer_codes c ON c.attribute = h.attribute_model AND c.attribute_value = h.value""",
)
def h5(s):
    return wave_report(s).select(
        "attribute", "wavekey", "value", r6("share"), r6("imputed_distribution"),
        r6("simulation_distribution"), r6("lower_bound_distribution"), r6("upper_bound_distribution"), "sakey", "svkey",
    )


def wave_report(s):
    limits = stored(bounds(s), "bounds")
    best = stored(ocal.calibrate_waves(s.scores, limits, EVALS), "multipliers")
    final = ocal.select_values(s.scores, best).withColumnRenamed("selected_value", "value")
    sizes = classes_of(s)
    histogram = osh.class_histogram(final, osh.wave_list(s.respondents), "value", "attribute_model", sizes)
    return ocal.wave_distribution_report(histogram, limits, s.answer_codes)
