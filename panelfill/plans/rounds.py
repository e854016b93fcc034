"""Round-robin imputation: features from the last round, one model per attribute and class, calibration."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfill import schemas
from panelfill.functions.survey import argmax_class, is_binomial
from panelfill.operators import boosting as ob
from panelfill.operators import calibration as ocal
from panelfill.operators import scores as osc
from panelfill.operators import shares as osh
from panelfill.operators.association import chi2_before_after, closest_features, ks_two_sample
from panelfill.operators.bootstrap import bootstrap_share_bounds
from panelfill.operators.features import FeatureSpec, assemble_features, covered_levels
from panelfill.operators.joins import not_in_keys
from panelfill.operators.labels import wide_labels
from panelfill.session import in_parallel
from panelfill.sources import tables


def core_and_latent(core: DataFrame, latent: DataFrame) -> DataFrame:
    """Answers given by everyone beside the latent layer."""
    return core.join(latent, ["uid", "set_uid"])


def round0_inputs(responses: DataFrame, latent: DataFrame, width: int) -> DataFrame:
    """Sparse answer rows to long codes, kept for the respondents of the latent layer."""
    long = tables.libsvm_to_long(responses.select("uid", "wavekey", "libsvm"), width=width)
    return long.join(latent.select("uid", "set_uid"), "uid")


def ready_attributes(plan: DataFrame) -> DataFrame:
    """Attributes that need no imputation in round 0."""
    return plan.where(~F.col("needs_imputation") & (F.col("proposed_round") == 0)).select("attribute").distinct()


def next_round_long(predictions: DataFrame, plan: DataFrame) -> DataFrame:
    """Answers of the last round that become features: those of attributes not complete at the start."""
    ready = ready_attributes(plan).select(F.col("attribute").alias("attribute_model"))
    return not_in_keys(predictions, ready, "attribute_model")


def next_round_features(
    predictions: DataFrame, plan: DataFrame, core: DataFrame, attributes: Sequence[str] | None = None
) -> DataFrame:
    """Wide form: the core matrix with one column per attribute of the last round (all, unless listed)."""
    kept = next_round_long(predictions, plan).withColumn("selected_value", F.col("selected_value").cast("int"))
    wide = wide_labels(kept.drop("wavekey"), attributes, value="selected_value", name="attribute_model")
    return core.join(wide, ["uid", "set_uid"])


def expected_models(plan: DataFrame) -> DataFrame:
    """Models of round 0 that need imputation, unless one of their answers is complete."""
    wanted = plan.where((F.col("proposed_round") == 0) & F.col("needs_imputation")).select(F.col("attribute").alias("model"))
    complete = plan.where(~F.col("needs_imputation")).select(F.col("attribute").alias("model"))
    return wanted.join(complete, "model", "left_anti").distinct()


def missing_models(expected: DataFrame, ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """Expected models without completion record, with their plan rows."""
    open_ = tables.pending_models(expected, ledger)
    return open_.join(plan.withColumnRenamed("attribute", "model"), "model", "left")


def run_times(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("iteration").agg(
        F.avg("total_time").alias("mean_time"), F.max("total_time").alias("max_time"), F.count(F.lit(1)).alias("n_models")
    )


@dataclass
class RoundConfig:
    params: ob.BoostParams = field(default_factory=ob.BoostParams)
    search_trials: int = 20
    reps: int = 1000
    evals: int = 20
    threads: int = 4
    seed: int = 0
    keep_own_imputation: bool = False
    excluded: tuple[str, ...] = ()  # attributes that are never features, such as demographics
    latent_top: int | None = None  # latent columns a model may use: those that tell respondents with and without its answer least
    min_share: float = 0.6  # round-0 features, where no core is given: attributes that more respondents than this answered


@dataclass
class RoundInputs:
    """Tables of one survey: respondents (uid, wavekey, set_uid, respondentweight), long labels
    (uid, wavekey, attribute, label, kind), plan, codes, latent layer, and the class count of each attribute.

    ``core`` lists the first-round features; without it they are chosen by coverage."""

    respondents: DataFrame
    labels: DataFrame
    plan: DataFrame
    codes: DataFrame
    latent: DataFrame
    latent_columns: tuple[str, ...]
    sizes: dict[str, int]
    core: tuple[str, ...] | None = None


def core_levels(inputs: RoundInputs, config: RoundConfig) -> dict[str, int]:
    """Answers that are features from the first round on, with their number of codes."""
    if inputs.core is not None:
        return {a: inputs.sizes[a] for a in inputs.core}
    return covered_levels(inputs.labels, config.min_share, inputs.sizes, inputs.plan.where("proposed_round = 0"))


def closest_latent(inputs: RoundInputs, attributes: Sequence[str], k: int) -> dict[str, tuple[str, ...]]:
    """Of each attribute the ``k`` latent columns whose distributions differ least between respondents with and without a label.

    One statistic job for all attributes and columns; what comes back are ``k`` names an attribute.
    """
    spark = inputs.latent.sparkSession
    asked = spark.createDataFrame([(a,) for a in attributes], "attribute string")
    known = inputs.labels.where(F.col("label").isNotNull()).select("uid", "attribute").distinct().withColumn("has", F.lit(True))
    long = inputs.latent.select("uid", *inputs.latent_columns).unpivot(["uid"], list(inputs.latent_columns), "feature", "value")
    rows = long.withColumn("attribute", F.explode(F.array(*[F.lit(a) for a in attributes]))).join(known, ["uid", "attribute"], "left")
    ks = ks_two_sample(rows.withColumn("has", F.coalesce("has", F.lit(False))), "value", "has", ["attribute", "feature"])
    found = closest_features(ks, k, ["attribute"]).join(asked, "attribute").groupBy("attribute").agg(F.collect_list("feature").alias("features")).collect()
    return {r.attribute: tuple(r.features) for r in found}


def fit_attribute(frame: DataFrame, attribute: str, num_class: int, spec: FeatureSpec, config: RoundConfig, latent: Sequence[str] | None = None):
    """Search and final fit of every class of one attribute: (models, best trials, retried).

    Every respondent of ``frame`` is scored along the final fit; only train and test rows with a label are searched on.
    ``latent`` lists the latent columns to use, all unless given.
    """
    own = [] if config.keep_own_imputation else [attribute]
    unused = [n for c in spec.latent if latent is not None and c not in latent for n in (c, f"{c}_missing")]
    allowed = tuple(i for i, n in enumerate(spec.names) if n not in (*config.excluded, *own, *unused))
    classes = [1] if "_" in attribute else list(range(num_class))
    used = F.col("set_uid").isin("train", "test") & F.col("label").isNotNull()

    def run(k):
        target = frame.withColumns({"y": (F.col("label") == k).cast("double"), "is_train": F.when(used, F.col("set_uid") == "train")})
        base = replace(config.params, features=allowed, least_bins=spec.max_bins)
        found = None
        if config.search_trials:
            known = target.where("is_train IS NOT NULL")
            found = ob.random_search(known, spec.names, config.search_trials, base, ob.SEARCH_SEED + config.seed, threads=1, key=f"{attribute}:{k}")
            picked = tuple(i for i in (found.params.features or allowed) if i in allowed) or allowed
            base = replace(found.params, features=picked)
        return k, ob.final_fit(target, base), found

    done = in_parallel([lambda k=k: run(k) for k in classes], config.threads)
    models = {k: m for k, m, _ in done}
    trials = [(attribute, k, f.log_loss, f.roc_score) for k, _, f in done if f is not None]
    return models, trials, any(f.retried for *_, f in done if f is not None)


def read_journal(spark: SparkSession, path: str, iteration: int) -> DataFrame:
    """The newest record of every model of a round, from a ledger or a journal; empty if there is none yet."""
    if not tables.path_exists(spark, path):
        return spark.createDataFrame([], schemas.LEDGER)
    rows = spark.read.schema(schemas.LEDGER).option("recursiveFileLookup", True).parquet(path).where(F.col("iteration") == iteration)
    return rows.groupBy("model").agg(F.max_by(F.struct("*"), "finish_time").alias("r")).select("r.*")


def run_round(
    spark: SparkSession, inputs: RoundInputs, root: str, iteration: int, config: RoundConfig, previous: DataFrame | None = None, redo: bool = False
) -> DataFrame:
    """Fit and fill every pending attribute of a round; returns the predictions written.

    Models are fitted side by side from the driver's threads; calibration, bounds, shares and
    chi-square then run once for all attributes. Results are written before they are read
    again, so a later round starts from files, and small ones are joined by their known size.

    A fitted model is committed on its own: its scores, importance and search trials first, and then one row of the
    round's ``journal``, written last so that it stands for all of them. A model that has its row is not
    fitted again when the round is run again; the ``ledger`` gets the models' rows once the shared results are
    written. ``redo`` fits all models anew.
    """
    folder, ledger_path = f"{root}/iteration_{iteration}", f"{root}/ledger"
    journal_path = f"{folder}/journal"
    expected = spark.createDataFrame([(r.model,) for r in expected_models(inputs.plan).collect()], "model string")
    open_ = tables.pending_models(expected, read_journal(spark, ledger_path, iteration), redo)
    pending = sorted(r.model for r in open_.collect())
    unfitted = sorted(r.model for r in tables.pending_models(open_, read_journal(spark, journal_path, iteration), redo).collect())
    if not pending:
        return read_predictions(spark, folder)

    core = core_levels(inputs, config)
    answers = inputs.labels.where(F.col("attribute").isin(list(core))).select("uid", "attribute", F.col("label").alias("code"))
    levels = dict(core)
    if previous is not None:
        filled = next_round_long(previous, inputs.plan)
        answers = answers.unionByName(filled.select("uid", F.col("attribute_model").alias("attribute"), F.col("selected_value").alias("code")))
        levels |= {r.model: inputs.sizes[r.model] for r in expected.orderBy("model").collect() if r.model not in core}
    spec = FeatureSpec(levels, inputs.latent_columns)
    people = inputs.respondents.select(
        "uid", "wavekey", "set_uid", "respondentweight", F.col("respondentweight").cast("double").alias("weight")
    )
    base = assemble_features(people, answers, spec, inputs.latent).persist(StorageLevel.MEMORY_AND_DISK)

    latent = closest_latent(inputs, unfitted, config.latent_top) if config.latent_top and unfitted else {}

    def fit(attribute):
        """Fit one attribute, write what belongs to it to its own partitions, and record it."""
        start = time.time()
        num_class = inputs.sizes[attribute]
        own = inputs.labels.where(F.col("attribute") == attribute).select("uid", F.col("label").cast("int").alias("label"))
        frame = base.join(own, "uid", "left").persist(StorageLevel.MEMORY_AND_DISK)
        models, trials, retried = fit_attribute(frame, attribute, num_class, spec, config, latent.get(attribute))
        scores = ob.state_proba(models, frame, "_" in attribute).select(
            "uid", "set_uid", "wavekey", "respondentweight", "weight", F.lit(attribute).alias("attribute_model"), F.lit(num_class).alias("num_class"), "label", "probs"
        )
        written = {"scores": scores, "featureImportance": ob.feature_importance(spark, {(attribute, k): m for k, m in models.items()}, spec.names)}
        if trials:
            written["trials"] = spark.createDataFrame(trials, "attribute_model string, value int, log_loss double, roc_score double")
        tables.write_result_bundle(folder, written)
        frame.unpersist()
        finish = time.time()
        tables.commit_record(spark.createDataFrame([(attribute, num_class, iteration, start, finish, finish - start, retried)], schemas.LEDGER), journal_path)

    in_parallel([lambda a=a: fit(a) for a in unfitted], config.threads)
    base.unpersist()

    keep = ["uid", "set_uid", "wavekey", "respondentweight", "weight", "attribute_model", "num_class", "label", "probs"]
    results = read_kind(spark, folder, "scores").where(F.col("attribute_model").isin(pending)).select(*keep)
    classes = results.select("attribute_model", "num_class").distinct()
    labeled = results.where(F.col("label").isNotNull())
    tables.write_result_bundle(folder, {"bounds": bootstrap_share_bounds(labeled, classes, config.reps, config.seed)})
    bounds = read_kind(spark, folder, "bounds").where(F.col("attribute_model").isin(pending))
    tables.write_result_bundle(
        folder,
        {"multipliers": ocal.calibrate_waves(results, bounds, config.evals, config.seed), "thresholds": test_thresholds(results)},
    )
    final = with_max_prediction(
        ocal.select_values(results, read_kind(spark, folder, "multipliers")), read_kind(spark, folder, "thresholds")
    )
    predictions = final.select("uid", "set_uid", "wavekey", "attribute_model", "label", "max_prediction", "selected_value", "respondentweight")
    probabilities = results.select("uid", "set_uid", "wavekey", "attribute_model", "label", "probs")
    tables.write_result_bundle(folder, {"predictions": predictions, "probabilities": probabilities})

    back = read_predictions(spark, folder).where(F.col("attribute_model").isin(pending))
    weighted = back.withColumn("weight", F.col("respondentweight").cast("double"))
    histogram = osh.class_histogram(weighted, osh.wave_list(inputs.respondents), "selected_value", "attribute_model", classes)
    report = ocal.wave_distribution_report(histogram.withColumnRenamed("selected_value", "value"), bounds, inputs.codes)
    trials = None
    if tables.path_exists(spark, f"{folder}/trials"):
        trials = read_kind(spark, folder, "trials").where(F.col("attribute_model").isin(pending)).select("attribute_model", "value", "log_loss", "roc_score")
    metrics = osc.metrics_table(results, trials).withColumn("attribute_model", F.col("model"))
    long = answers.select("uid", F.col("attribute").alias("feature"), F.col("code").cast("double").alias("value"))
    chi2 = chi2_before_after(
        long, labeled.select("uid", "attribute_model", "label"), back.select("uid", "attribute_model", F.col("selected_value").alias("label"))
    )
    tables.write_result_bundle(
        folder, {"distributions": report.withColumnRenamed("attribute", "attribute_model"), "metrics": metrics, "chiSquare": chi2}
    )
    finished = read_journal(spark, journal_path, iteration).where(F.col("model").isin(pending))
    tables.append_ledger(finished.select(*schemas.LEDGER.names).coalesce(1), ledger_path)
    return read_predictions(spark, folder)


def test_thresholds(results: DataFrame) -> DataFrame:
    """Best threshold of each binomial model on the test split."""
    test = results.where((F.col("set_uid") == "test") & is_binomial(F.col("attribute_model")))
    return osc.best_mcc_threshold(osc.roc_curve(osc.class_scores(test)), ["attribute_model"])


def with_max_prediction(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Most probable class; a binomial model is positive from its threshold on."""
    joined = results.join(thresholds.select("attribute_model", "threshold"), "attribute_model", "left")
    positive = (F.col("probs")[1] >= F.coalesce("threshold", F.lit(0.5))).cast("int")
    winner = F.when(is_binomial(F.col("attribute_model")), positive).otherwise(argmax_class(F.col("probs")))
    return joined.withColumn("max_prediction", winner).drop("threshold")


def read_kind(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One result table of a round; model names are text even when they look like numbers."""
    path = f"{folder}/{kind}"
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("attribute_model", F.col("attribute_model").cast("string"))


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return read_kind(spark, folder, "predictions")


def run_rounds(spark: SparkSession, inputs: RoundInputs, root: str, rounds: int, config: RoundConfig) -> list[DataFrame]:
    """Rounds one after the other; the answers of each are the features of the next."""
    out: list[DataFrame] = []
    for iteration in range(rounds):
        out.append(run_round(spark, inputs, root, iteration, config, out[-1] if out else None))
    return out
