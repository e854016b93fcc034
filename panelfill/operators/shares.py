"""Weighted answer shares per wave and the reports made of them.

Facts are aggregated before any lookup is joined, so only the respondent weights meet the facts
row by row; totals, taxonomy and scaffolds join the small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.functions.survey import in_bounds, ratio
from panelfill.operators.joins import with_answer_codes


def wave_list(respondents: DataFrame) -> list[str]:
    """Sorted waves, one of which is a column of a wide report."""
    return sorted(r.wavekey for r in respondents.select("wavekey").distinct().collect())


def wave_totals(respondents: DataFrame) -> DataFrame:
    return respondents.groupBy("wavekey").agg(F.sum("respondentweight").cast("double").alias("wave_total_weight"))


def weighted_sums(answers: DataFrame, keys: Sequence[str], weight: str = "respondentweight") -> DataFrame:
    """Weight of each cell of ``keys``; partial sums leave the map side."""
    return answers.groupBy(*keys).agg(F.sum(weight).cast("double").alias("wave_attribute_weight"))


def with_weights(predictions: DataFrame, respondents: DataFrame) -> DataFrame:
    """Predictions with ``respondentweight``. Those a round writes carry it, and need no join."""
    if "respondentweight" in predictions.columns:
        return predictions
    return predictions.join(respondents.select("uid", "wavekey", "respondentweight"), ["uid", "wavekey"])


def wave_shares(answers: DataFrame, respondents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the wave's weight per cell; ``answers`` carry ``respondentweight``."""
    sums = weighted_sums(answers, [*keys, "wavekey"])
    return sums.join(wave_totals(respondents), "wavekey").withColumn(
        "wave_share", ratio(F.col("wave_attribute_weight"), F.col("wave_total_weight"))
    )


def average_over_waves(shares: DataFrame, keys: Sequence[str], n_waves: int, share: str = "wave_share") -> DataFrame:
    """Mean over all waves; a wave without rows counts as 0."""
    return shares.groupBy(*keys).agg((F.sum(share) / F.lit(float(n_waves))).alias("average_share"))


def pivot_waves(shares: DataFrame, keys: Sequence[str], waves: Sequence[str], share: str = "wave_share") -> DataFrame:
    """One column per wave (named by the wave) in the order given."""
    return shares.groupBy(*keys).pivot("wavekey", list(waves)).agg(F.max(share))


def fill_missing_waves(wide: DataFrame, waves: Sequence[str]) -> DataFrame:
    return wide.na.fill(0.0, list(waves))


def class_histogram(answers: DataFrame, waves: Sequence[str], value: str, model: str, classes: DataFrame) -> DataFrame:
    """Weighted share of every class in every wave where the model has answers, 0 for absent classes.

    ``classes`` has (model, num_class). ``answers`` carry ``weight``.
    """
    cells = answers.groupBy(model, "wavekey", value).agg(F.sum("weight").alias("w"))
    totals = cells.groupBy(model, "wavekey").agg(F.sum("w").alias("total"))
    scaffold = totals.join(classes, model).withColumn(value, F.explode(F.sequence(F.lit(0), F.col("num_class") - 1)))
    scaffold = scaffold.where(F.col("wavekey").isin(list(waves)))
    return scaffold.join(cells, [model, "wavekey", value], "left").select(
        model, "wavekey", value, (F.coalesce("w", F.lit(0.0)) / F.col("total")).alias("share")
    )


def mean_class_share(histogram: DataFrame, value: str, model: str) -> DataFrame:
    return histogram.groupBy(model, value).agg(F.avg("share").alias("imputed_distribution"))


def univariate_shares(predictions: DataFrame, codes: DataFrame, respondents: DataFrame) -> DataFrame:
    """Long form of the univariate report: share per answer and wave."""
    facts = with_weights(predictions, respondents)
    cells = wave_shares(facts, respondents, ["attribute_model", "selected_value"])
    return with_answer_codes(cells, codes).select("attribute", "sakey", "svkey", "wavekey", "wave_share")


def univariate_report(
    predictions: DataFrame, codes: DataFrame, respondents: DataFrame, round_number: int, waves: Sequence[str] | None = None
) -> DataFrame:
    """One row per answer: share in each wave, zero-filled mean over all waves, round."""
    waves = list(waves) if waves is not None else wave_list(respondents)
    shares = univariate_shares(predictions, codes, respondents)
    keys = ["attribute", "sakey", "svkey"]
    wave_columns = [F.max(F.when(F.col("wavekey") == w, F.col("wave_share"))).alias(w) for w in waves]
    average = (F.sum("wave_share") / F.lit(float(len(waves)))).alias("average_imputed_distribution")
    return shares.groupBy(*keys).agg(*wave_columns, average).withColumn("round", F.lit(round_number))


def bounded_report(distributions: DataFrame, iteration: int) -> DataFrame:
    """Distribution table of a round with the flag whether the share fell inside its bounds."""
    return distributions.withColumn(
        "bounded",
        in_bounds(
            F.col("imputed_distribution"), F.col("lower_bound_distribution"), F.col("upper_bound_distribution")
        ),
    ).withColumn("iteration", F.lit(iteration))


def production_shares(taxonomy: DataFrame, distributions: DataFrame) -> DataFrame:
    return (
        taxonomy.join(distributions, ["sakey", "svkey", "multi"])
        .select("attribute", "sakey", "svkey", "prod_distribution", "calc_distribution")
        .distinct()
    )


def imputed_vs_reference(univariate: DataFrame, production: DataFrame) -> DataFrame:
    """Imputed share relative to the calculated one."""
    return univariate.select("attribute", "sakey", "svkey", "average_imputed_distribution").join(
        production, ["attribute", "sakey", "svkey"]
    ).withColumn("share_ratio", ratio(F.col("average_imputed_distribution"), F.col("calc_distribution")))


def share_errors(shares: DataFrame, a: str, b: str) -> DataFrame:
    """Mean signed and mean squared difference per iteration; rows with a null are skipped."""
    diff = F.col(a) - F.col(b)
    return shares.groupBy("iteration").agg(
        F.avg(diff).alias("mean_error"), F.avg(diff * diff).alias("mean_squared_error"), F.count(diff).alias("n")
    )


def squared_error_histogram(shares: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of the squared difference per iteration."""
    err = shares.withColumn("l2", F.pow(F.col(a) - F.col(b), F.lit(2.0))).where(F.col("l2").isNotNull())
    limits = err.groupBy("iteration").agg(F.max("l2").alias("top"))
    binned = err.join(limits, "iteration").withColumn(
        "bin",
        F.when(F.col("top") == 0, F.lit(1)).otherwise(
            F.least(F.width_bucket("l2", F.lit(0.0), F.col("top"), F.lit(bins)), F.lit(bins))
        ).cast("long"),
    )
    return binned.groupBy("iteration", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"))


def wave_fit(points: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line of y on x per group."""
    return points.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
