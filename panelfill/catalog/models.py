"""Queries for model fitting, chained imputation and whole rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from panelfill.catalog.base import predictions_of, query, r6, u
from panelfill.catalog.statistics import FINAL, OBSERVED, chi2_sql, long_features, targets
from panelfill.functions import focal
from panelfill.operators import boosting as ob
from panelfill.operators import chained as och
from panelfill.operators import scores as osc
from panelfill.operators.association import chi2_before_after
from panelfill.operators.features import FeatureSpec, assemble_features, covered_levels
from panelfill.plans import chains as pc
from panelfill.plans import rounds as pr
from panelfill.session import new_folder
from panelfill.sources import tables
from panelfill.sources.survey import MODELS

LATENT = ("ld_0", "ld_1", "ld_2", "ld_3")
CORE = {"101": 5, "103_1031": 2}
SMALL = ob.BoostParams(rounds=3, patience=3, learning_rate=0.3, max_depth=3, gamma=0.5)


def codes(s):
    return s.labels.select("uid", "attribute", F.col("label").alias("code"))


def feature_frame(s, spec=None):
    people = s.respondents.select("uid", "wavekey", "set_uid", F.col("respondentweight").cast("double").alias("weight"))
    return assemble_features(people, codes(s), spec or FeatureSpec(CORE, LATENT), s.latent)


def training_rows(s, attribute="104_1043", k=1):
    """Train and test rows of one binary target."""
    return scored_rows(s, attribute, k).where("is_train IS NOT NULL")


def scored_rows(s, attribute="104_1043", k=1):
    """All respondents; those without label or outside train and test take no part in the fit."""
    own = s.labels.where(F.col("attribute") == attribute).select("uid", "label")
    rows = feature_frame(s).join(own, "uid", "left")
    used = F.col("set_uid").isin("train", "test") & F.col("label").isNotNull()
    return rows.withColumns({"y": (F.col("label") == k).cast("double"), "is_train": F.when(used, F.col("set_uid") == "train")})


@query(
    "g3_assemble_features",
    """WITH used AS (SELECT attribute FROM matrix WHERE attribute IN (SELECT attribute FROM model_plan WHERE proposed_round = 0) AND attribute IN (SELECT attribute_model FROM model_sizes)
                     GROUP BY attribute HAVING count(DISTINCT uid) > 0.6 * (SELECT count(DISTINCT uid) FROM matrix))
       SELECT r.uid, r.set_uid, u.attribute AS feature, round(CAST(coalesce(l.label + 1, 0) AS DOUBLE), 9) AS value
       FROM respondents r CROSS JOIN used u LEFT JOIN coded_labels l ON l.uid = r.uid AND l.attribute = u.attribute
       UNION ALL
       SELECT r.uid, r.set_uid, v.feature, round(v.value, 9) FROM respondents r LEFT JOIN latent l ON l.uid = r.uid
       CROSS JOIN (SELECT avg(ld_0) AS m0, avg(ld_1) AS m1, avg(ld_2) AS m2, avg(ld_3) AS m3 FROM latent) m,
       LATERAL (SELECT unnest(['ld_0', 'ld_0_missing', 'ld_1', 'ld_1_missing', 'ld_2', 'ld_2_missing', 'ld_3', 'ld_3_missing']) AS feature,
                       unnest([coalesce(l.ld_0, m0), CAST(l.ld_0 IS NULL AS DOUBLE), coalesce(l.ld_1, m1), CAST(l.ld_1 IS NULL AS DOUBLE),
                               coalesce(l.ld_2, m2), CAST(l.ld_2 IS NULL AS DOUBLE), coalesce(l.ld_3, m3), CAST(l.ld_3 IS NULL AS DOUBLE)]) AS value) v""",
)
def g3(s):
    """First-round features: attributes that more than 60 % answered, and the latent layer."""
    from pyspark.ml.functions import vector_to_array

    spec = FeatureSpec(covered_levels(s.labels, 0.6, MODELS, s.model_plan.where("proposed_round = 0")), LATENT)
    long = feature_frame(s, spec).select("uid", "set_uid", F.posexplode(vector_to_array("features")).alias("position", "value"))
    names = s.spark.createDataFrame(pa.table({"position": pa.array(range(len(spec.names)), pa.int32()), "feature": spec.names}))
    return long.join(names, "position").select("uid", "set_uid", "feature", F.round("value", 9).alias("value"))


_g = "((2 * y - 1) * (1 - q) ** 0.5::DOUBLE * (0.5::DOUBLE * q * ln(q) + q - 1))"


@query(
    "g6_goss_weights",
    f"""WITH grads AS (SELECT uid, attribute_model, value, y, {_g} AS g FROM (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS q FROM class_scores WHERE set_uid = 'train')),
        binned AS (SELECT *, CAST(floor(log2(greatest(abs(g), 2.0::DOUBLE ** -64)) * 64) AS INTEGER) AS bin FROM grads),
        places AS (SELECT *, floor(sum(n) OVER (PARTITION BY attribute_model, value) * 0.2::DOUBLE)
                         - coalesce(sum(n) OVER (PARTITION BY attribute_model, value ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
                   FROM (SELECT attribute_model, value, bin, count(*) AS n FROM binned GROUP BY ALL)),
        edges AS (SELECT attribute_model, value, max(bin) AS edge, arg_max(open / n, bin) AS share FROM places WHERE open >= 0 AND open <= n GROUP BY ALL),
        sided AS (SELECT b.*, b.bin > e.edge OR (b.bin = e.edge AND {u('b.uid', '42', "'edge'")} < e.share) AS large
                  FROM binned b JOIN edges e ON e.attribute_model = b.attribute_model AND e.value = b.value)
        SELECT uid, attribute_model, value, y, round(g, 6) AS g, CASE WHEN large THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS goss_weight
        FROM sided WHERE large OR {u('uid', '42', "'goss'")} < 0.125""",
)
def g6(s):
    """Gradients of all models and classes, reduced to the large ones and a weighted sample."""
    train = osc.class_scores(ob.split_rows(s.scores, "train"))
    grads = train.withColumn("g", focal.focal_grad(F.col("y"), F.col("p"), 0.5))
    rate = ob.effective_other_rate(0.2, 0.125)
    kept = ob.goss_weights(grads, "g", 0.2, rate, 42, ["attribute_model", "value"])
    return kept.select("uid", "attribute_model", "value", "y", r6("g"), F.round("goss_weight", 9).alias("goss_weight"))


# one tree of one split on the two answers that everybody gave; without focusing its parts have closed forms
ONE_SPLIT = ob.BoostParams(rounds=1, max_depth=1, learning_rate=0.3, gamma=0.0)
SPLIT_SQL = """
    cells AS (SELECT r.uid, r.set_uid, l.label AS y, a.label + 1 AS f0, b.label + 1 AS f1 FROM respondents r
              LEFT JOIN coded_labels l ON l.uid = r.uid AND l.attribute = '104_1043'
              JOIN coded_labels a ON a.uid = r.uid AND a.attribute = '101' JOIN coded_labels b ON b.uid = r.uid AND b.attribute = '103_1031'),
    train AS (SELECT * FROM cells WHERE set_uid = 'train' AND y IS NOT NULL),
    start AS (SELECT s, 1 / (1 + exp(-s)) AS p, 1 / (1 + exp(-s)) * (1 - 1 / (1 + exp(-s))) AS h FROM (SELECT ln(sum(y)::DOUBLE / sum(1 - y)) AS s FROM train)),
    levels AS (SELECT f, v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM (SELECT 0 AS f, f0 AS v, y FROM train UNION ALL SELECT 1, f1, y FROM train) GROUP BY f, v),
    cuts AS (SELECT *, sum(n) OVER w AS nl, sum(pos) OVER w AS pl, sum(n) OVER (PARTITION BY f) AS na, sum(pos) OVER (PARTITION BY f) AS pa,
                    row_number() OVER (PARTITION BY f ORDER BY pos / n, v) AS place
             FROM levels WINDOW w AS (PARTITION BY f ORDER BY pos / n, v ROWS UNBOUNDED PRECEDING)),
    cut AS (SELECT *, pl * pl / nl + (pa - pl) * (pa - pl) / (na - nl) - pa * pa / na AS gain FROM cuts WHERE nl < na ORDER BY gain DESC LIMIT 1),
    stepped AS (SELECT c.*, CASE WHEN w.v IS NOT NULL THEN (k.pl / k.nl - t.p) / t.h ELSE ((k.pa - k.pl) / (k.na - k.nl) - t.p) / t.h END AS step
                FROM cells c CROSS JOIN cut k CROSS JOIN start t
                LEFT JOIN (SELECT u.v FROM cuts u JOIN cut k ON u.f = k.f AND u.place <= k.place) w ON w.v = CASE k.f WHEN 0 THEN c.f0 ELSE c.f1 END),
    moved AS (SELECT s.*, 1 / (1 + exp(-(t.s + 0.3::DOUBLE * s.step))) AS p FROM stepped s CROSS JOIN start t)"""


def one_split(s):
    """Respondents with the two answers as levels, and the model of one split."""
    spec = FeatureSpec(CORE)
    own = s.labels.where(F.col("attribute") == "104_1043").select("uid", "label")
    rows = feature_frame(s, spec).join(own, "uid", "left")
    used = F.col("set_uid").isin("train", "test") & F.col("label").isNotNull()
    rows = rows.withColumns({"y": F.col("label").cast("double"), "is_train": F.when(used, F.col("set_uid") == "train")})
    return rows, ob.fit_newton_boost(rows, ONE_SPLIT)


@query(
    "g7_one_split",
    f"""WITH {SPLIT_SQL}
        SELECT f0, f1, count(*) FILTER (set_uid = 'train' AND y IS NOT NULL) AS n_train, round(max(step), 6) AS step,
               (SELECT round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) FROM moved WHERE set_uid = 'train' AND y IS NOT NULL) AS train_loss,
               (SELECT round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) FROM moved WHERE set_uid = 'test' AND y IS NOT NULL) AS test_loss
        FROM moved GROUP BY f0, f1""",
)
def g7_one_split(s):
    """Newton step of every pair of answers after one round, and the losses."""
    from pyspark.ml.functions import vector_to_array

    rows, model = one_split(s)
    scored, step = model.steps[0].values(rows, "features")
    level = vector_to_array("features")
    train, test = model.history[0]
    return scored.groupBy(level[0].cast("int").alias("f0"), level[1].cast("int").alias("f1")).agg(
        F.count_if("is_train").alias("n_train"), r6(F.max(step), "step"), r6(F.lit(train), "train_loss"), r6(F.lit(test), "test_loss")
    )


@query("g8_one_split_scores", f"WITH {SPLIT_SQL} SELECT uid, set_uid, round(p, 6) AS p FROM moved")
def g8_one_split(s):
    """Probabilities of every respondent, from the state of the fit."""
    rows, model = one_split(s)
    return ob.state_proba({1: model}, rows, binomial=True).select("uid", "set_uid", r6(F.col("probs")[1], "p"))


@query(
    "g9_one_split_importance",
    f"""WITH {SPLIT_SQL}
        SELECT '104_1043' AS attribute_model, 1 AS svkey_index, CASE x.f WHEN 0 THEN '101' ELSE '103_1031' END AS feature, 1 AS best_iteration, i.importance_type,
               CASE WHEN x.f <> k.f THEN 0.0 WHEN i.importance_type = 'split' THEN 1.0 ELSE round(k.gain / t.h, 6) END::DOUBLE AS importance
        FROM (VALUES (0), (1)) x(f) CROSS JOIN cut k CROSS JOIN start t CROSS JOIN (VALUES ('split'), ('gain')) i(importance_type)""",
)
def g9_one_split(s):
    _, model = one_split(s)
    return ob.feature_importance(s.spark, {("104_1043", 1): model}, FeatureSpec(CORE).names).withColumn("importance", r6("importance"))


@query("g7_fit_newton_boost")
def g7(s):
    """Loss after each round on the train and test rows."""
    model = ob.fit_newton_boost(training_rows(s), SMALL)
    rows = [(i + 1, a, b, i + 1 == model.best_iteration) for i, (a, b) in enumerate(model.history)]
    return s.spark.createDataFrame(rows, "iteration int, train_loss double, test_loss double, best boolean")


@query("g7_fit_newton_boost_regularised")
def g7_regularised(s):
    """The same with leaf penalties, gradient sampling, row and feature fractions."""
    params = ob.replace(
        SMALL, lambda_l1=0.5, lambda_l2=2.0, max_delta_step=5.0, top_rate=0.3, other_rate=0.2, bagging_fraction=0.9,
        feature_fraction=0.8, min_sum_hessian_in_leaf=1.0, alpha=0.4,
    )
    model = ob.fit_newton_boost(training_rows(s), params)
    rows = [(i + 1, a, b, i + 1 == model.best_iteration) for i, (a, b) in enumerate(model.history)]
    return s.spark.createDataFrame(rows, "iteration int, train_loss double, test_loss double, best boolean")


@query("g8_predict_proba")
def g8(s):
    """Probabilities of every respondent for a pick-many answer."""
    rows = scored_rows(s)
    scored = ob.state_proba({1: ob.fit_newton_boost(rows, SMALL)}, rows, binomial=True)
    return scored.select("uid", "set_uid", F.posexplode("probs").alias("value", "p")).select("uid", "set_uid", "value", r6("p"))


@query("g9_feature_importance")
def g9(s):
    model = ob.fit_newton_boost(training_rows(s), SMALL)
    names = FeatureSpec(CORE, LATENT).names
    return ob.feature_importance(s.spark, {("104_1043", 1): model}, names).withColumn("importance", r6("importance"))


def search(s):
    """Trials of a search over the default ranges for one class: 10 of 3 boosting rounds, instead of 20 of 200. Run once in an application."""

    def run():
        rows = training_rows(s).persist()
        found = ob.random_search(rows, FeatureSpec(CORE, LATENT).names, 10, ob.replace(SMALL, least_bins=32), key="104_1043:1")
        rows.unpersist()
        return found.trials.withColumn("chosen", F.col("loss") == found.loss)

    return s.stored("search", run)


@query("g10_random_search")
def g10(s):
    return search(s).select("trial", "loss", "log_loss", "roc_score", "random_score", "failed", "chosen")


@query("g11_search_log")
def g11(s):
    """The log as it is appended, trial by trial, with all settings."""
    path = new_folder(s.spark, "search-log")
    ob.search_log(search(s).drop("chosen"), "104_1043").write.mode("append").parquet(path)
    return s.spark.read.parquet(path)


@query("g12_cross_validate")
def g12(s):
    rows = training_rows(s).select("uid", "features", "y")
    return ob.cross_validate(rows, ob.replace(SMALL, rounds=2), k=5, threads=5)


@query("g14_final_fit")
def g14(s):
    """Quality of the refitted model on every split."""
    rows = scored_rows(s)
    frame = ob.state_proba({1: ob.final_fit(rows, SMALL)}, rows, binomial=True)
    results = frame.withColumn("attribute_model", F.lit("104_1043"))
    return osc.metrics_table(results)


# ---- chained imputation ----------------------------------------------------------------------

MICE_VARIABLES = och.Variables({"102": 5, "104_1041": 2, "104_1043": 2})
START = f"""(SELECT r.uid, m.attribute, l.label, coalesce(l.label, k.label) AS start
    FROM respondents r CROSS JOIN (SELECT DISTINCT attribute FROM coded_labels WHERE attribute IN ('102', '104_1041', '104_1043')) m
    LEFT JOIN coded_labels l ON l.uid = r.uid AND l.attribute = m.attribute
    JOIN (SELECT attribute, label, sum(n) OVER (PARTITION BY attribute ORDER BY label) AS upto,
                 sum(n) OVER (PARTITION BY attribute ORDER BY label) - n AS below, sum(n) OVER (PARTITION BY attribute) AS n_all
          FROM (SELECT attribute, label, count(*) AS n FROM coded_labels GROUP BY attribute, label)) k
      ON k.attribute = m.attribute AND floor({u('r.uid', 'm.attribute', '42', "'start'")} * k.n_all) >= k.below
     AND floor({u('r.uid', 'm.attribute', '42', "'start'")} * k.n_all) < k.upto)"""


def start_cells(s):
    names = s.spark.createDataFrame([(n,) for n in MICE_VARIABLES.names], "attribute string")
    labels = s.labels.where(F.col("attribute").isin(MICE_VARIABLES.names))
    return och.mice_init(labels, s.respondents, names, seed=42)


def mice_inputs(s):
    fixed = FeatureSpec(CORE, LATENT)
    people = s.respondents.select("uid", "wavekey", "set_uid")
    labels = s.labels.where(F.col("attribute").isin(MICE_VARIABLES.names)).select("uid", "attribute", "label")
    frame = och.mice_frame(assemble_features(people, codes(s), fixed, s.latent), labels, MICE_VARIABLES)
    return frame, labels, fixed


@query(
    "i1_mice_frame",
    """SELECT r.uid, r.set_uid, max(CASE WHEN l.attribute = '102' THEN l.label END) AS a102,
              max(CASE WHEN l.attribute = '104_1041' THEN l.label END) AS a104_1041, max(CASE WHEN l.attribute = '104_1043' THEN l.label END) AS a104_1043,
              coalesce(max(CASE WHEN l.attribute = '101' THEN l.label END) + 1, 0)::DOUBLE AS f101
       FROM respondents r LEFT JOIN coded_labels l ON l.uid = r.uid GROUP BY r.uid, r.set_uid""",
)
def i1(s):
    from pyspark.ml.functions import vector_to_array

    frame, _, _ = mice_inputs(s)
    return frame.select(
        "uid", "set_uid", *[F.col("labels")[i].alias(f"a{n}") for i, n in enumerate(MICE_VARIABLES.names)],
        vector_to_array("features")[0].alias("f101"),
    )


@query("i2_mice_init", f"SELECT uid, attribute, label, start FROM {START}")
def i2(s):
    return start_cells(s)


@query("i3_mice_step")
def i3(s):
    """One variable refitted and redrawn: counts of its values among observed and missing cells."""
    frame, labels, fixed = mice_inputs(s)
    state = och.start_state(frame, labels, MICE_VARIABLES, 42)
    after, _ = och.mice_step(state, MICE_VARIABLES, 0, fixed, 1, 42)
    return (
        och.long_state(after, MICE_VARIABLES, 1).where(F.col("attribute") == "102")
        .groupBy(F.col("label").isNotNull().alias("observed"), "selected_value").agg(F.count(F.lit(1)).alias("n"))
    )


def chain(s):
    """Folder and tables of the chained imputation of question 102: run once with its defaults, then found finished."""
    root = s.place("chain")
    out = pc.run_chain(s.spark, round_inputs(s), root, 0, "102", pc.ChainConfig())
    return root, out


@query("i4_mice")
def i4(s):
    """Values after every sweep of the chained imputation of question 102, by sweep and value."""
    root, _ = chain(s)
    states = s.spark.read.parquet(f"{root}/iteration_0/chains/work/102/state")
    return states.groupBy("iteration", F.get("values", F.lit(0)).alias("selected_value")).agg(F.count(F.lit(1)).alias("n"))


@query("i5_mice_apply")
def i5(s):
    """Models fitted on train respondents impute everyone."""
    frame, labels, fixed = mice_inputs(s)
    train = frame.where(F.col("set_uid") == "train")
    run = och.mice(train, labels, MICE_VARIABLES, fixed)
    after = och.mice_apply(run.models, frame, labels, MICE_VARIABLES, fixed)
    return och.long_state(after, MICE_VARIABLES, 5).select("uid", "attribute", "label", "selected_value")


def complete(s):
    """Complete data of the start values, which need no model."""
    return och.complete_data(start_cells(s).withColumnRenamed("start", "imputed"), s.respondents)


@query(
    "i6_complete_data",
    f"""SELECT c.uid, r.wavekey, r.set_uid, CAST(r.respondentweight AS DOUBLE) AS weight, c.attribute, c.label, c.start AS selected_value
        FROM {START} c JOIN respondents r ON r.uid = c.uid""",
)
def i6(s):
    return complete(s).select("uid", "wavekey", "set_uid", "weight", "attribute", "label", "selected_value")


@query(
    "i7_mice_share_report",
    f"""WITH fin AS (SELECT c.attribute, r.wavekey, c.start AS v, CAST(r.respondentweight AS DOUBLE) AS weight FROM {START} c JOIN respondents r ON r.uid = c.uid),
        tot AS (SELECT attribute, wavekey, sum(weight) AS total FROM fin GROUP BY ALL),
        cells AS (SELECT attribute, wavekey, v, sum(weight) AS w FROM fin GROUP BY ALL),
        hist AS (SELECT t.attribute, t.wavekey, k.value, coalesce(c.w, 0) / t.total AS share FROM tot t
                 JOIN model_sizes m ON m.attribute_model = t.attribute JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS value) k ON k.value < m.num_class
                 LEFT JOIN cells c ON c.attribute = t.attribute AND c.wavekey = t.wavekey AND c.v = k.value)
        SELECT '102' AS target_attribute, h.attribute, c.sakey, c.svkey, h.wavekey, round(h.share, 6) AS share,
               round(avg(h.share) OVER (PARTITION BY h.attribute, h.value), 6) AS imputed_distribution
        FROM hist h JOIN answer_codes c ON c.attribute = h.attribute AND c.attribute_value = h.value""",
)
def i7(s):
    from panelfill.operators.shares import wave_list

    sizes = s.spark.createDataFrame(list(MICE_VARIABLES.sizes.items()), "attribute string, num_class int")
    shares = och.mice_shares(complete(s), wave_list(s.respondents), sizes, s.answer_codes, "102")
    return shares.withColumns({"share": r6("share"), "imputed_distribution": r6("imputed_distribution")})


@query(
    "i8_mice_predictions",
    f"""SELECT '102' AS attribute_model, c.attribute, 'total' AS output, c.uid, r.wavekey, c.label, c.start AS selected_value
        FROM {START} c JOIN respondents r ON r.uid = c.uid
        UNION ALL SELECT '102', c.attribute, 'focal', c.uid, r.wavekey, c.label, c.start FROM {START} c JOIN respondents r ON r.uid = c.uid WHERE c.attribute = '102'""",
)
def i8(s):
    own, total = och.mice_predictions(complete(s), "102")
    both = total.withColumn("output", F.lit("total")).unionByName(own.withColumn("output", F.lit("focal")))
    return both.select("attribute_model", "attribute", "output", "uid", "wavekey", "label", "selected_value")


CHAINED = "(SELECT attribute_model AS attribute, num_class FROM model_sizes WHERE attribute_model IN ('102', '104_1041', '104_1042', '104_1043'))"


@query(
    "i6_chain_complete",
    f"""SELECT r.uid, r.wavekey, r.set_uid, v.attribute, l.label, coalesce(l.label, -1) AS kept, true AS valid
        FROM respondents r CROSS JOIN {CHAINED} v LEFT JOIN coded_labels l ON l.uid = r.uid AND l.attribute = v.attribute""",
)
def i6_chain(s):
    """Every cell of the finished chain: observed values are kept (-1 stands for a drawn one), drawn ones are classes of their variable."""
    total = chain(s)[1]["totalPredictions"]
    sizes = s.spark.createDataFrame(list(MODELS.items()), "attribute string, num_class int")
    return total.join(sizes, "attribute").select(
        "uid", "wavekey", "set_uid", "attribute", "label", F.when(F.col("label").isNull(), -1).otherwise(F.col("selected_value")).alias("kept"),
        (F.col("selected_value").isNotNull() & (F.col("selected_value") >= 0) & (F.col("selected_value") < F.col("num_class"))).alias("valid"),
    )


@query(
    "i7_chain_shares",
    f"""SELECT '102' AS target_attribute, v.attribute, w.wavekey, v.num_class AS n_answers, 1.0::DOUBLE AS total, true AS above_observed
        FROM {CHAINED} v CROSS JOIN (SELECT DISTINCT wavekey FROM respondents) w WHERE v.num_class = 5
        UNION ALL SELECT '102', v.attribute, w.wavekey, 1, NULL, true FROM {CHAINED} v CROSS JOIN (SELECT DISTINCT wavekey FROM respondents) w WHERE v.num_class = 2""",
)
def i7_chain(s):
    """Shares of the finished chain: all answers of a question add up to 1, and none has less than its observed weight."""
    shares = chain(s)[1]["distributions"]
    people = s.respondents.select("uid", "wavekey", F.col("respondentweight").cast("double").alias("weight"))
    totals = people.groupBy("wavekey").agg(F.sum("weight").alias("all_weight"))
    seen = s.labels.select("uid", "attribute", "label").join(people, "uid").groupBy("attribute", "label", "wavekey").agg(F.sum("weight").alias("w"))
    seen = seen.join(s.answer_codes.select("attribute", F.col("attribute_value").alias("label"), "svkey"), ["attribute", "label"])
    seen = seen.join(totals, "wavekey").select("svkey", "wavekey", (F.col("w") / F.col("all_weight")).alias("observed"))
    both = shares.join(seen, ["svkey", "wavekey"], "left")
    whole = F.when(~F.contains("attribute", F.lit("_")), F.round(F.sum("share"), 6))
    return both.groupBy("target_attribute", "attribute", "wavekey").agg(
        F.count(F.lit(1)).cast("int").alias("n_answers"), whole.alias("total"), F.bool_and(F.col("share") >= F.coalesce("observed", F.lit(0.0)) - 1e-9).alias("above_observed")
    )


@query(
    "i8_chain_predictions",
    f"""SELECT '102' AS attribute_model, v.attribute, o.output, count(*) AS n, count(l.label) AS n_observed
        FROM respondents r CROSS JOIN {CHAINED} v LEFT JOIN coded_labels l ON l.uid = r.uid AND l.attribute = v.attribute
        JOIN (VALUES ('total'), ('focal')) o(output) ON o.output = 'total' OR v.attribute = '102' GROUP BY ALL""",
)
def i8_chain(s):
    """Rows of the two prediction tables of the finished chain, and how many hold an observed value unchanged."""
    out = chain(s)[1]
    both = out["totalPredictions"].withColumn("output", F.lit("total")).unionByName(out["focalPredictions"].withColumn("output", F.lit("focal")))
    return both.groupBy("attribute_model", "attribute", "output").agg(F.count("selected_value").alias("n"), F.count_if(F.col("label") == F.col("selected_value")).alias("n_observed"))


@query("i9_mice_importance")
def i9(s):
    """Importance of every feature for every variable, after the last sweep of the finished chain."""
    return chain(s)[1]["featureImportance"].withColumn("feature_importance", r6("feature_importance"))


# ---- rounds ----------------------------------------------------------------------------------


def round_inputs(s):
    return pr.RoundInputs(
        respondents=s.respondents, labels=s.labels.select("uid", "wavekey", "attribute", "label", "kind"), plan=s.model_plan,
        codes=s.answer_codes, latent=s.latent, latent_columns=LATENT, sizes=MODELS, core=tuple(CORE),
    )


def rounds(s):
    """Folder and predictions of two rounds, run once in an application and then found finished.

    Smaller than the defaults, which are 200 boosting rounds and 20 search trials a class: 2 boosting rounds without search.
    Bounds and calibration are those of the defaults.
    """
    config = pr.RoundConfig(params=ob.replace(SMALL, rounds=2), search_trials=0, threads=4)
    root = s.place("rounds")
    return root, pr.run_rounds(s.spark, round_inputs(s), root, 2, config)


@query("j6_run_rounds")
def j6(s):
    """Two rounds; answers per round, attribute and value."""
    parts = [df.withColumn("round", F.lit(i)) for i, df in enumerate(rounds(s)[1])]
    return parts[0].unionByName(parts[1]).groupBy("round", "attribute_model", "selected_value").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("n_observed")
    )


@query(
    "j6_round_rows",
    """SELECT r.round, p.uid, p.wavekey, p.set_uid, m.attribute AS attribute_model, l.label, coalesce(l.label, -1) AS kept, true AS valid
       FROM respondents p CROSS JOIN (SELECT DISTINCT attribute FROM model_plan WHERE needs_imputation AND proposed_round = 0) m
       CROSS JOIN (VALUES (0), (1)) r(round) LEFT JOIN coded_labels l ON l.uid = p.uid AND l.attribute = m.attribute""",
)
def j6_rows(s):
    """Every cell that the two rounds filled: observed answers are kept (-1 stands for an imputed one), imputed ones are classes of their model."""
    parts = [df.withColumn("round", F.lit(i)) for i, df in enumerate(rounds(s)[1])]
    sizes = s.spark.createDataFrame(list(MODELS.items()), "attribute_model string, num_class int")
    valid = F.col("selected_value").isNotNull() & (F.col("selected_value") >= 0) & (F.col("selected_value") < F.col("num_class"))
    return parts[0].unionByName(parts[1]).join(sizes, "attribute_model").select(
        "round", "uid", "wavekey", "set_uid", "attribute_model", "label",
        F.when(F.col("label").isNull(), -1).otherwise(F.col("selected_value")).alias("kept"), valid.alias("valid"),
    )


@query(
    "a13_pending_models",
    """SELECT DISTINCT attribute AS model, n_respondents FROM model_plan WHERE NOT (needs_imputation AND proposed_round = 0)""",
)
def a13(s):
    """Attributes of the plan without a record in the ledger of the first round."""
    root, _ = rounds(s)
    ledger = pr.read_journal(s.spark, f"{root}/ledger", 0)
    return tables.pending_models(s.model_plan.select(F.col("attribute").alias("model"), "n_respondents").distinct(), ledger)


@query(
    "a14_write_result_bundle",
    f"""SELECT 'predictions' AS kind, attribute_model, count(*) AS n FROM predictions GROUP BY attribute_model
        UNION ALL SELECT 'probabilities', attribute_model, count(*) FROM scores GROUP BY attribute_model
        UNION ALL SELECT 'metrics', attribute_model, count(*) FROM auc GROUP BY attribute_model
        UNION ALL SELECT 'featureImportance', '104_1043', 4
        UNION ALL SELECT 'chiSquare', attribute_model, count(*) FROM (SELECT attribute_model FROM {chi2_sql(OBSERVED)} UNION ALL SELECT attribute_model FROM {chi2_sql(FINAL)}) GROUP BY attribute_model
        UNION ALL SELECT 'distributions', h.attribute_model, count(*) FROM histogram h JOIN answer_codes c ON c.attribute = h.attribute_model AND c.attribute_value = h.value GROUP BY h.attribute_model""",
)
def a14(s):
    """All six kinds of results; a second write of one model replaces that model only."""
    from panelfill.catalog.aggregates import classes_of, weighted_predictions
    from panelfill.operators.joins import with_answer_codes
    from panelfill.operators.shares import class_histogram, wave_list

    root = new_folder(s.spark, "results")
    final = predictions_of(s).select("uid", "attribute_model", F.col("selected_value").alias("label"))
    cells = class_histogram(weighted_predictions(s), wave_list(s.respondents), "selected_value", "attribute_model", classes_of(s))
    _, model = one_split(s)
    frames = {
        "predictions": predictions_of(s),
        "probabilities": s.scores.drop("weight", "num_class"),
        "metrics": osc.metrics_table(s.scores).withColumn("attribute_model", F.col("model")),
        "featureImportance": ob.feature_importance(s.spark, {("104_1043", 1): model}, FeatureSpec(CORE).names),
        "chiSquare": chi2_before_after(long_features(s), targets(s), final),
        "distributions": with_answer_codes(cells, s.answer_codes).drop("attribute"),
    }
    tables.write_result_bundle(root, frames)
    tables.write_result_bundle(root, {"predictions": predictions_of(s).where(F.col("attribute_model") == "102")})
    out = None
    for kind in frames:
        part = pr.read_kind(s.spark, root, kind).groupBy("attribute_model").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "attribute_model", "n")
        out = part if out is None else out.unionByName(part)
    return out
