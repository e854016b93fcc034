import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from panelfill.functions import focal
from panelfill.operators import association
from panelfill.operators import boosting as ob
from panelfill.operators import chained as och
from panelfill.operators.features import FeatureSpec, assemble_features
from panelfill.plans import chains as pc
from panelfill.plans import rounds as pr
from panelfill.session import new_folder
from panelfill.sources import tables
from panelfill.sources.survey import MODELS, Survey

SMALL = ob.BoostParams(rounds=4, patience=4, learning_rate=0.5, max_depth=2, gamma=0.5)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """y depends on the first entry, a category of three levels, and a little on the second."""
    rng = np.random.default_rng(0)
    data = []
    for i in range(1500):
        c, x = int(rng.integers(3)), float(rng.normal())
        p = 1 / (1 + math.exp(-([-2.0, 0.0, 2.0][c] + 0.5 * x)))
        data.append((i, [float(c), x, float(rng.normal())], float(rng.random() < p), i % 4 != 0))
    spec = {"ml_attr": {"attrs": {"nominal": [{"idx": 0, "name": "c", "vals": ["0", "1", "2"]}], "numeric": [{"idx": 1, "name": "x"}, {"idx": 2, "name": "noise"}]}, "num_attrs": 3}}
    df = spark.createDataFrame(data, "uid long, v array<double>, y double, is_train boolean")
    return df.select("uid", array_to_vector("v").alias("features", metadata=spec), "y", "is_train").persist()


@pytest.fixture(scope="module")
def model(rows):
    return ob.fit_newton_boost(rows, SMALL)


def test_loss_falls_and_beats_a_constant(rows, model):
    train = [a for a, _ in model.history]
    assert all(b < a for a, b in zip(train, train[1:]))
    constant = rows.where("NOT is_train").select(F.avg(focal.focal_loss(F.col("y"), F.lit(1 / (1 + math.exp(-model.init))), 0.5))).first()[0]
    assert model.history[model.best_iteration - 1][1] < constant * 0.9
    loss, auc = ob.test_quality(model)
    assert auc > 0.8 and loss < math.log(2)


def test_first_leaf_is_the_newton_step(rows, model):
    p0 = F.lit(1 / (1 + math.exp(-model.init)))
    scored, value = model.steps[0].values(rows.where("is_train"), "features")
    q = focal.true_class_probability(F.col("y"), p0)
    sums = scored.withColumn("step", value).groupBy("step").agg(
        F.sum(focal.focal_grad_at(F.col("y"), q, 0.5)).alias("g"), F.sum(focal.newton_hess_at(F.col("y"), q, 0.5)).alias("h")
    ).collect()
    assert len(sums) > 1
    assert all(r.step == pytest.approx(-r.g / r.h, rel=1e-9) for r in sums)


def test_same_seed_same_model_on_any_partitioning(rows, model):
    again = ob.fit_newton_boost(rows.repartition(5, "uid"), SMALL)
    assert np.allclose(again.history, model.history, rtol=1e-9)


def test_early_stop_uses_the_best_round(rows):
    wild = ob.replace(SMALL, rounds=12, patience=2, learning_rate=6.0)
    stopped = ob.fit_newton_boost(rows, wild)
    tests = [t for _, t in stopped.history]
    assert stopped.best_iteration == tests.index(min(tests)) + 1
    assert len(tests) < 12


def test_regularised_leaves_shrink(rows):
    strong = ob.fit_newton_boost(rows, ob.replace(SMALL, rounds=1, lambda_l2=1e6))
    assert max(abs(v) for v in strong.steps[0].leaves) < 1e-2
    capped = ob.fit_newton_boost(rows, ob.replace(SMALL, rounds=1, max_delta_step=0.1))
    assert max(abs(v) for v in capped.steps[0].leaves) <= 0.1 + 1e-12
    mixed = ob.fit_newton_boost(
        rows, ob.replace(SMALL, lambda_l1=0.1, lambda_l2=1.0, top_rate=0.3, other_rate=0.3, bagging_fraction=0.9, feature_fraction=0.7, min_sum_hessian_in_leaf=1.0)
    )
    assert mixed.history[-1][0] < mixed.history[0][0]


def test_checkpointed_rounds_change_nothing(rows, model):
    often = ob.fit_newton_boost(rows, ob.replace(SMALL, checkpoint_every=1))
    assert np.allclose(often.history, model.history, rtol=1e-9)


def test_probabilities(rows, model):
    both = ob.predict_proba({1: model}, rows, binomial=True).select("probs").collect()
    assert all(len(r.probs) == 2 and sum(r.probs) == pytest.approx(1.0) and 0 < r.probs[1] < 1 for r in both)
    many = ob.predict_proba({0: model, 1: model, 2: model}, rows, binomial=False).first()
    assert len(many.probs) == 3 and many.probs[0] == many.probs[2]


def test_importance_finds_the_driver(spark, model):
    got = ob.feature_importance(spark, {("5_1", 1): model}, ["c", "x", "noise"]).collect()
    gain = {r.feature: r.importance for r in got if r.importance_type == "gain"}
    split = {r.feature: r.importance for r in got if r.importance_type == "split"}
    assert set(gain) == {"c", "x", "noise"} and gain["c"] == max(gain.values())
    assert sum(split.values()) >= model.best_iteration
    assert {(r.attribute_model, r.svkey_index, r.best_iteration) for r in got} == {("5_1", 1, model.best_iteration)}


def test_feature_switches_are_respected(spark, rows):
    only = ob.fit_newton_boost(rows, ob.replace(SMALL, rounds=1, features=(2,)))
    got = ob.feature_importance(spark, {("m", 1): only}, ["c", "x", "noise"]).collect()
    assert {r.feature for r in got} == {"noise"}


def _tree_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("UDF(")


def test_state_scores_equal_the_chain_of_trees(rows, spark):
    """Also of rows outside the fit, after an early stop, and without a tree in the plan."""
    some = rows.withColumn("is_train", F.when(F.col("uid") % 5 != 2, F.col("is_train"))).withColumn("y", F.when(F.col("is_train").isNotNull(), F.col("y")))
    for params in (SMALL, ob.replace(SMALL, rounds=8, patience=2, learning_rate=3.0), ob.replace(SMALL, lambda_l2=1.0, feature_fraction=0.7, checkpoint_every=2, top_rate=0.4, other_rate=0.3)):
        model = ob.fit_newton_boost(some, params)
        chain = {r.uid: r.raw for r in model.raw_score(some, "raw").select("uid", "raw").collect()}
        state = {r.uid: r.score for r in model.scores.collect()}
        assert state.keys() == chain.keys() and all(state[u] == pytest.approx(chain[u], abs=1e-12) for u in chain)
        people = spark.range(1500).withColumnRenamed("id", "uid")
        probs = ob.state_proba({1: model}, people, True)
        assert _tree_nodes(probs) == 0 and _tree_nodes(ob.predict_proba({1: model}, some, True)) > 0
        assert {r.uid: r.probs[1] for r in probs.collect()} == pytest.approx({u: 1 / (1 + math.exp(-x)) for u, x in chain.items()})
    many = ob.state_proba({0: model, 1: model, 2: model}, people, False).first().probs
    assert len(many) == 3 and many[0] == many[2]


def test_node_table_holds_the_gain_of_a_split(spark):
    """One split on a category: weighted impurity before and after, by hand."""
    data = [(i, [float(i % 2)], float(i % 10 < (8 if i % 2 else 2)), True) for i in range(400)]
    spec = {"ml_attr": {"attrs": {"nominal": [{"idx": 0, "name": "c", "vals": ["0", "1"]}]}, "num_attrs": 1}}
    df = spark.createDataFrame(data, "uid long, v array<double>, y double, is_train boolean")
    df = df.select("uid", array_to_vector("v").alias("features", metadata=spec), "y", "is_train")
    model = ob.fit_newton_boost(df, ob.BoostParams(rounds=2, max_depth=1, gamma=0.0, learning_rate=0.5))
    got = {(r.svkey_index, r.importance_type): r.importance for r in ob.feature_importance(spark, {("a", 0): model, ("a", 1): model}, ["c"]).collect()}
    y = np.array([r[2] for r in data])
    side = np.array([r[1][0] for r in data])
    score, gain = np.full(400, math.log(y.sum() / (400 - y.sum()))), 0.0
    for _ in range(model.best_iteration):
        p = 1 / (1 + np.exp(-score))
        h, target = p * (1 - p), (y - p) / (p * (1 - p))
        spread = lambda at: (h[at] * (target[at] - np.average(target[at], weights=h[at])) ** 2).sum()
        gain += spread(side >= 0) - spread(side == 0) - spread(side == 1)
        for c in (0, 1):
            score[side == c] += 0.5 * np.average(target[side == c], weights=h[side == c])
    assert got == {(k, t): pytest.approx(v) for k in (0, 1) for t, v in (("gain", gain), ("split", model.best_iteration))}


def test_goss_weights_like_a_sorted_reference(spark):
    from panelfill.functions.rng import hash_uniform_py

    df = spark.range(600).select(F.col("id").alias("uid"), (F.pow(F.lit(0.97), F.col("id") % 300) * F.when(F.col("id") % 2 == 0, -1).otherwise(1)).alias("g"), (F.col("id") >= 300).cast("int").alias("part"))
    rows = [(r.uid, abs(r.g), r.part) for r in df.collect()]
    grouped = {r.uid: r.goss_weight for r in ob.goss_weights(df, "g", 0.2, 0.4, 9, ["part"]).collect()}
    whole = {r.uid: r.goss_weight for r in ob.goss_weights(df, "g", 0.2, 0.4, 9).collect()}
    for got, groups in ((grouped, [[r for r in rows if r[2] == p] for p in (0, 1)]), (whole, [rows])):
        want = {}
        for group in groups:
            ordered = sorted(group, key=lambda r: -r[1])
            top = {u for u, *_ in ordered[: len(group) // 5]}
            want |= {u: 1.0 for u in top} | {u: 2.0 for u, *_ in group if u not in top and hash_uniform_py(u, 9, "goss") < 0.5}
        assert got == want


def test_a_sample_without_rows_is_a_failed_trial(spark, rows):
    few = rows.where("uid < 40")
    space = {"bagging_fraction": ("uniform", 0.0, 1e-6)}
    with pytest.raises(ob.NoRows):
        ob.fit_newton_boost(few, ob.replace(SMALL, bagging_fraction=1e-9))
    found = ob.random_search(few, ["c", "x", "noise"], 2, ob.replace(SMALL, rounds=1), space=space, threads=1)
    assert found.retried and all(r.failed for r in found.trials.collect())


def test_models_draw_trials_of_their_own(spark):
    one, two, again = (ob.trial_table(spark, 5, ["a"], key=k).drop("trial").collect() for k in ("101:0", "101:1", "101:0"))
    assert one == again and one != two


def test_goss_keeps_large_gradients_and_the_total(spark):
    df = spark.range(20000).select(F.col("id").alias("uid"), ((F.col("id") % 100) / 100.0 - 0.3).alias("g"))
    kept = ob.goss_weights(df, "g", 0.2, 0.1, 1)
    limit = 0.5
    assert kept.where(F.abs("g") > limit).count() == df.where(F.abs("g") > limit).count()
    total = df.agg(F.sum(F.abs("g"))).first()[0]
    assert kept.agg(F.sum(F.abs("g") * F.col("goss_weight"))).first()[0] == pytest.approx(total, rel=0.05)
    assert kept.count() == pytest.approx(0.3 * 20000, rel=0.1)


def test_folds_are_balanced_within_labels(spark):
    df = spark.range(1003).select(F.col("id").alias("uid"), F.when(F.col("id") % 10 < 8, 0).otherwise(1).alias("label"))
    folds = ob.stratified_folds(df, [], 5, 3)
    sizes = folds.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in sizes if r.label == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
    again = {r.uid: r.fold for r in ob.stratified_folds(df.repartition(9), [], 5, 3).collect()}
    assert again == {r.uid: r.fold for r in folds.collect()}


def test_class_weights_are_scaled_by_their_maximum(spark):
    df = spark.createDataFrame([(1, "m", 0), (2, "m", 1)], "uid long, attribute_model string, label int")
    weights = spark.createDataFrame([("m", 0, 2.0), ("m", 1, 5.0)], "attribute_model string, label int, weight double")
    got = {r.uid: r.class_weight for r in ob.class_weights(df, weights, ["attribute_model"]).collect()}
    assert got == {1: pytest.approx(0.4), 2: 1.0}


def test_trials_stay_in_their_ranges(spark):
    trials = ob.trial_table(spark, 50, ["a", "b", "c"]).collect()
    for name, (kind, low, high) in ob.SPACE.items():
        values = [r[name] for r in trials]
        if kind == "lognormal":
            assert min(values) > 0
        elif kind == "choice":
            assert set(values) == {0.0, 1.0}
        else:
            assert low <= min(values) and max(values) <= high and len(set(values)) > 5
    row = trials[0]
    params = ob.params_of(row, ob.BoostParams())
    assert params.other_rate == pytest.approx(row.other_rate * (1 - row.top_rate))
    assert params.alpha == (row.alpha if row.use_alpha else None)
    assert params.features == (tuple(i for i, on in enumerate(row.feature_on) if on) or None)


def test_search_picks_the_least_loss_and_falls_back(spark, rows):
    space = {"max_depth": ("integer", 1, 3), "learning_rate": ("uniform", 0.2, 0.6)}
    found = ob.random_search(rows, ["c", "x", "noise"], 3, ob.replace(SMALL, rounds=1), space=space, threads=3)
    trials = found.trials.collect()
    assert found.loss == min(r.loss for r in trials if not r.failed) and not found.retried
    assert all(r.loss == pytest.approx(r.log_loss + r.random_score) and 0 < r.random_score < 1 for r in trials)
    log = ob.search_log(found.trials, "m").collect()
    assert len(log) == 3 and all(r.n_features == sum(t.feature_on) for r in log for t in trials if t.trial == r.trial)
    # leaves this large are impossible, so every trial predicts a constant and all fail
    flat = ob.random_search(rows, ["c", "x", "noise"], 2, ob.replace(SMALL, rounds=1, min_data_in_leaf=10**6), space={}, threads=2)
    assert flat.retried and all(r.failed for r in flat.trials.collect())


def test_cross_validation_covers_every_fold(rows):
    out = ob.cross_validate(rows.select("uid", "features", "y"), ob.replace(SMALL, rounds=2), k=3, threads=3).collect()
    assert sorted((r.iteration, r.folds) for r in out) == [(1, 3), (2, 3)]
    assert [r.iteration for r in out if r.best] == [min(out, key=lambda r: r.mean_loss).iteration]


def test_assembled_vectors(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "uid long")
    answers = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "b", 0), (2, "zz", 1)], "uid long, attribute string, code int")
    latent = spark.createDataFrame([(1, 4.0), (2, None), (3, 8.0)], "uid long, ld_0 double")
    spec = FeatureSpec({"a": 2, "b": 3}, ("ld_0",))
    out = assemble_features(people, answers, spec, latent)
    got = {r.uid: r.v for r in out.select("uid", vector_to_array("features").alias("v")).collect()}
    assert got == {1: [1.0, 3.0, 4.0, 0.0], 2: [0.0, 1.0, 6.0, 1.0], 3: [0.0, 0.0, 8.0, 0.0]}
    assert out.schema["features"].metadata["ml_attr"]["num_attrs"] == 4
    assert spec.without("b") == [0, 2, 3]


# ---- chained imputation ----------------------------------------------------------------------


def test_start_values_follow_observed_frequencies(spark):
    people = spark.range(4000).select(F.col("id").alias("uid"))
    labels = people.where("uid % 2 = 0").select("uid", F.lit("v").alias("attribute"), F.when(F.col("uid") % 10 == 0, 1).otherwise(0).alias("label"))
    sizes = spark.createDataFrame([("v",)], "attribute string")
    got = och.mice_init(labels, people, sizes, 1)
    assert got.count() == 4000 and got.where("label IS NOT NULL AND label <> start").count() == 0
    drawn = got.where("label IS NULL").agg(F.avg("start")).first()[0]
    assert drawn == pytest.approx(0.2, abs=0.03)


def test_class_draws(spark):
    probs = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    draws = [spark.range(1).select(och.draw_class(probs, F.lit(u)).alias("d")).first().d for u in (0.0, 0.19, 0.2, 0.69, 0.7, 0.999999)]
    assert draws == [0, 0, 1, 1, 2, 2]


def test_chained_imputation_keeps_observed_and_recovers_structure(spark):
    rng = np.random.default_rng(4)
    people, labels = [], []
    for uid in range(1200):
        x = float(rng.normal())
        a, b = int(x > 0), int(x + 0.2 * rng.normal() > 0.3)
        people.append((uid, "train" if uid % 3 else "test", x))
        if rng.random() < 0.7:
            labels.append((uid, "a", a))
        if rng.random() < 0.7:
            labels.append((uid, "b", b))
    base = spark.createDataFrame(people, "uid long, set_uid string, ld_0 double")
    fixed = FeatureSpec({}, ("ld_0",))
    features = assemble_features(base.select("uid", "set_uid"), spark.createDataFrame([], "uid long, attribute string, code int"), fixed, base)
    table = spark.createDataFrame(labels, "uid long, attribute string, label int")
    variables = och.Variables({"a": 2, "b": 2})
    frame = och.mice_frame(features, table, variables)
    run = och.mice(frame, table, variables, fixed, iterations=2, trees=5, depth=4)
    sweeps = run.sweeps.persist()
    assert sweeps.count() == 1200 * 2 * 2
    assert sweeps.where("label IS NOT NULL AND label <> selected_value").count() == 0
    truth = {uid: int(x > 0) for uid, _, x in people}
    filled = [(r.uid, r.selected_value) for r in sweeps.where("iteration = 2 AND attribute = 'a' AND label IS NULL").collect()]
    assert np.mean([truth[u] == v for u, v in filled]) > 0.85
    importance = och.mice_importance(run.models, variables, fixed, "a", spark).collect()
    assert {(r.attribute, r.feature) for r in importance} == {(a, f) for a, o in (("a", "b"), ("b", "a")) for f in (o, "ld_0", "ld_0_missing")}
    applied = och.mice_apply(run.models, frame, table, variables, fixed)
    final = {r.uid: tuple(r["values"]) for r in run.state.collect()}
    assert {r.uid: tuple(r["values"]) for r in applied.collect()} == final


def test_a_chain_resumes_after_the_last_committed_sweep(spark, monkeypatch):
    s = Survey(spark, FOLDER)
    labels = s.labels.select("uid", "wavekey", "attribute", "label", "kind")
    inputs = pr.RoundInputs(s.respondents, labels, s.model_plan, s.answer_codes, s.latent, ("ld_0", "ld_1"), MODELS, ("101", "103_1031"))
    config = pc.ChainConfig(iterations=2, covariates=1, trees=3, depth=2)
    root, steps, real = new_folder(spark, "chain"), [], och.mice_step

    def step(state, variables, target, fixed, iteration, *args):
        steps.append((iteration, target))
        if len(steps) == 4:
            raise RuntimeError("lost")
        return real(state, variables, target, fixed, iteration, *args)

    monkeypatch.setattr(och, "mice_step", step)
    with pytest.raises(RuntimeError):
        pc.run_chain(spark, inputs, root, 0, "102", config)
    work = f"{root}/iteration_0/chains/work/102"
    assert steps == [(1, 0), (1, 1), (2, 0), (2, 1)] and och.finished_sweeps(spark, work) == 1
    first = sorted(map(tuple, spark.read.parquet(f"{work}/state/iteration=1").collect()))
    out = pc.run_chain(spark, inputs, root, 0, "102", config)
    assert steps[4:] == [(2, 0), (2, 1)] and sorted(map(tuple, spark.read.parquet(f"{work}/state/iteration=1").collect())) == first
    total, n = out["totalPredictions"], s.respondents.count()
    assert total.count() == 2 * n and total.where("label IS NOT NULL AND label <> selected_value OR selected_value IS NULL").isEmpty()
    assert out["focalPredictions"].count() == n and {r.attribute for r in out["featureImportance"].select("attribute").distinct().collect()} == {r.attribute for r in total.select("attribute").distinct().collect()}
    assert out["distributions"].where("attribute = '102'").groupBy("wavekey").agg(F.sum("share").alias("x")).where("abs(x - 1) > 1e-9").isEmpty()
    # a finished target is not run again, unless asked to
    pc.run_chain(spark, inputs, root, 0, "102", config)
    assert len(steps) == 6
    pc.run_chain(spark, inputs, root, 0, "102", config, redo=True)
    assert steps[6:] == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_start_state_is_the_start_of_every_cell(spark):
    s = Survey(spark, FOLDER)
    variables = och.Variables({"102": 5, "104_1041": 2})
    labels = s.labels.where(F.col("attribute").isin(variables.names)).select("uid", "attribute", "label")
    frame = och.mice_frame(s.respondents.select("uid"), labels, variables)
    sizes = spark.createDataFrame([(n,) for n in variables.names], "attribute string")
    cells = {(r.uid, r.attribute): r.start for r in och.mice_init(labels, s.respondents, sizes, 5).collect()}
    state = {r.uid: r["values"] for r in och.start_state(frame, labels, variables, 5).collect()}
    assert len(state) * 2 == len(cells) and all(v == [cells[u, n] for n in variables.names] for u, v in state.items())


# ---- rounds ----------------------------------------------------------------------------------


def test_rounds_fill_hidden_answers(spark):
    """Hide 30 % of a known answer by hash; the filled share must come closer to the truth than the majority class."""
    from panelfill.functions.rng import hash_uniform

    s = Survey(spark, FOLDER)
    hidden = (F.col("attribute") == "104_1043") & (hash_uniform(F.col("uid"), "hide") < 0.3)
    labels = s.labels.where(~hidden).select("uid", "wavekey", "attribute", "label", "kind")
    plan = s.model_plan.where(F.col("attribute").isin("101", "103_1031", "104_1041", "104_1043"))
    inputs = pr.RoundInputs(s.respondents, labels, plan, s.answer_codes, s.latent, ("ld_0", "ld_1", "ld_2", "ld_3"), MODELS, ("101", "103_1031"))
    config = pr.RoundConfig(params=ob.replace(SMALL, rounds=3, learning_rate=0.5), search_trials=0, reps=40, evals=8)
    root = new_folder(spark, "rounds")
    first, second = pr.run_rounds(spark, inputs, root, 2, config)
    n = s.respondents.count()
    for round_ in (first, second):
        assert round_.groupBy("attribute_model").count().where(F.col("count") != n).count() == 0
        assert round_.where("selected_value IS NULL").count() == 0
        assert round_.where("label IS NOT NULL AND label <> selected_value").count() == 0
    truth = s.labels.where(hidden).select("uid", F.col("label").alias("truth"))
    got = second.where("attribute_model = '104_1043'").join(truth, "uid").agg(F.avg("selected_value").alias("share"), F.avg("truth").alias("truth"), F.count("truth").alias("n")).first()
    assert got.n > 200
    assert abs(got.share - got.truth) < abs(1.0 - got.truth)
    # everything is in the ledger and the journal: a second run fits nothing and returns the same rows
    ledger = spark.read.parquet(f"{root}/ledger").count()
    again = pr.run_round(spark, inputs, root, 0, config)
    assert again.count() == first.count() and spark.read.parquet(f"{root}/ledger").count() == ledger == 4
    for kind in ("probabilities", "metrics", "featureImportance", "chiSquare", "distributions", "bounds", "multipliers"):
        assert tables.path_exists(spark, f"{root}/iteration_1/{kind}")
    metrics = pr.read_kind(spark, f"{root}/iteration_1", "metrics")
    assert {r.data_slice for r in metrics.collect()} == {"1_train", "1_test", "1_validation"}
    report = pr.read_kind(spark, f"{root}/iteration_1", "distributions").where("value = 1").collect()
    assert all(0 <= r.share <= 1 and r.lower_bound_distribution <= r.upper_bound_distribution for r in report)


def test_latent_columns_of_a_model_are_the_closest(spark, monkeypatch):
    s = Survey(spark, FOLDER)
    labels = s.labels.select("uid", "wavekey", "attribute", "label", "kind")
    inputs = pr.RoundInputs(s.respondents, labels, s.model_plan, s.answer_codes, s.latent, ("ld_0", "ld_1", "ld_2", "ld_3"), MODELS, ("101",))
    picked = pr.closest_latent(inputs, ["102", "104_1043"], 2)
    for attribute, names in picked.items():
        flagged = s.latent.unpivot(["uid"], ["ld_0", "ld_1", "ld_2", "ld_3"], "feature", "value")
        flagged = flagged.join(s.labels.where(F.col("attribute") == attribute).select("uid", F.lit(True).alias("has")), "uid", "left").withColumn("has", F.coalesce("has", F.lit(False)))
        ks = {r.feature: (r.p_value, -r.statistic) for r in association.ks_two_sample(flagged, "value", "has", ["feature"]).collect() if r.p_value is not None}
        assert set(names) == set(sorted(ks, key=lambda f: ks[f], reverse=True)[:2])
    seen = {}
    monkeypatch.setattr(ob, "final_fit", lambda rows, params: seen.setdefault("features", params.features))
    spec = FeatureSpec({"101": 5}, ("ld_0", "ld_1"))
    frame = spark.createDataFrame([(1, "train", 1)], "uid long, set_uid string, label int")
    pr.fit_attribute(frame, "104_1043", 2, spec, pr.RoundConfig(search_trials=0), ("ld_1",))
    assert [spec.names[i] for i in seen["features"]] == ["101", "ld_1", "ld_1_missing"]


def test_default_boosting_stops_early_and_improves(rows):
    """The defaults, once: 200 rounds with a patience of 30."""
    model = ob.fit_newton_boost(rows, ob.BoostParams())
    assert 30 < len(model.history) <= 200 and model.best_iteration < len(model.history)
    assert model.history[model.best_iteration - 1][1] < model.history[0][1]


def test_a_round_resumes_after_the_last_committed_model(spark, monkeypatch):
    """The second fit fails; the next run keeps the first model and fits the others."""
    s = Survey(spark, FOLDER)
    labels = s.labels.select("uid", "wavekey", "attribute", "label", "kind")
    plan = s.model_plan.where(F.col("attribute").isin("101", "103_1031", "104_1041", "104_1043"))
    inputs = pr.RoundInputs(s.respondents, labels, plan, s.answer_codes, s.latent, ("ld_0", "ld_1"), MODELS)
    config = pr.RoundConfig(params=ob.replace(SMALL, rounds=1), search_trials=0, reps=20, evals=3, threads=1)
    assert set(pr.core_levels(inputs, config)) == {"101", "103_1031", "103_1032"} & set(MODELS) | {a for a in ("104_1041", "104_1043") if labels.where(F.col("attribute") == a).count() > 0.6 * s.respondents.count()}
    root, fitted = new_folder(spark, "rounds"), []
    real = pr.fit_attribute

    def failing(frame, attribute, *args):
        assert args[-1] is None
        fitted.append(attribute)
        if len(fitted) == 2:
            raise RuntimeError("lost")
        return real(frame, attribute, *args)

    monkeypatch.setattr(pr, "fit_attribute", failing)
    with pytest.raises(RuntimeError):
        pr.run_round(spark, inputs, root, 0, config)
    assert fitted == ["104_1041", "104_1043"] and not tables.path_exists(spark, f"{root}/ledger")
    journal = pr.read_journal(spark, f"{root}/iteration_0/journal", 0).collect()
    assert [r.model for r in journal] == ["104_1041"]
    before = pr.read_kind(spark, f"{root}/iteration_0", "scores").select("attribute_model", "uid", "probs").collect()
    done = pr.run_round(spark, inputs, root, 0, config)
    assert fitted == ["104_1041", "104_1043", "104_1043"]
    assert {r.attribute_model for r in done.select("attribute_model").distinct().collect()} == {"104_1041", "104_1043"}
    after = pr.read_kind(spark, f"{root}/iteration_0", "scores").where("attribute_model = '104_1041'").select("attribute_model", "uid", "probs").collect()
    assert sorted(before) == sorted(after)
    ledger = spark.read.parquet(f"{root}/ledger").collect()
    assert sorted(r.model for r in ledger) == ["104_1041", "104_1043"] and journal[0].finish_time in {r.finish_time for r in ledger}
    for kind in ("featureImportance", "metrics", "distributions"):
        assert pr.read_kind(spark, f"{root}/iteration_0", kind).select("attribute_model").distinct().count() == 2
    # a redo fits both again and leaves one set of results
    n = done.count()
    pr.run_round(spark, inputs, root, 0, config, redo=True)
    assert fitted[3:] == ["104_1041", "104_1043"] and pr.read_predictions(spark, f"{root}/iteration_0").count() == n
