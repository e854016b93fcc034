"""Audiences: pairs of answers, and the weighted share of respondents who hold both."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.functions.survey import pair_key, ratio
from panelfill.operators.joins import lookup_both_sides
from panelfill.operators.running import bucket_count
from panelfill.operators.runs import packed_runs
from panelfill.operators.sampling import random_sample
from panelfill.operators.shares import wave_totals, with_weights
from panelfill.session import ship, stored

AUDIENCES_A_BLOCK = 1 << 16
RESPONDENTS_AT_ONCE = 1024
PAIR = ["attribute1", "attribute2", "sakey_1", "sakey_2", "svkey_1", "svkey_2"]


def question_pairs_on_waves(answer_pairs: DataFrame, min_waves: int = 2) -> DataFrame:
    """Question pairs asked together on at least ``min_waves`` waves."""
    return (
        answer_pairs.groupBy("sakey_1", "sakey_2")
        .agg(F.countDistinct("wavekey").alias("n_waves"))
        .where(F.col("n_waves") >= min_waves)
    )


def either_side(pairs: DataFrame, key: str) -> DataFrame:
    """Distinct keys found on either side of a pair table."""
    left = pairs.select(F.col(f"{key}_1").alias(key))
    return left.unionByName(pairs.select(F.col(f"{key}_2").alias(key))).distinct()


def audience_candidates(answer_pairs: DataFrame, imputed: DataFrame) -> DataFrame:
    """Answer pairs whose questions co-occur on two waves or more and are both imputed.

    ``imputed`` has (sakey, svkey, attribute); like the pairs it is a stored table. The question
    filter is a semi join on small key tables; nothing is collected.
    """
    common = either_side(question_pairs_on_waves(answer_pairs), "sakey").intersect(imputed.select("sakey"))
    pairs = answer_pairs.select("sakey_1", "svkey_1", "sakey_2", "svkey_2").distinct()
    for side in (1, 2):
        pairs = pairs.join(common.select(F.col("sakey").alias(f"sakey_{side}")), f"sakey_{side}", "left_semi")
    names = imputed.select("sakey", "svkey", "attribute").distinct()
    for side in (1, 2):
        renamed = names.select(
            F.col("sakey").alias(f"sakey_{side}"), F.col("svkey").alias(f"svkey_{side}"), F.col("attribute").alias(f"attribute{side}")
        )
        pairs = pairs.join(renamed, [f"sakey_{side}", f"svkey_{side}"])
    return pairs.select(*PAIR)


def sample_audiences(candidates: DataFrame, n: int = 5000, seed: int = 0) -> DataFrame:
    return random_sample(candidates, n, ["sakey_1", "svkey_1", "sakey_2", "svkey_2"], seed)


def audience_keys(audiences: DataFrame, external: DataFrame) -> DataFrame:
    """External key of both answers and the audience name ``<avkey1>,<avkey2>``."""
    mapped = lookup_both_sides(audiences, external, "svkey", ["avkey"])
    return mapped.withColumn("audience", F.concat_ws(",", "avkey1", "avkey2"))


def _with_id(audiences: DataFrame) -> DataFrame:
    key = pair_key(*[F.col(c) for c in PAIR])
    return audiences.select(*PAIR, key.alias("custom_audience_expression"))


class AudienceIndex:
    """A bounded block of audiences, by answer: of each first answer the audiences it opens and the answers that complete them."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.answers = np.unique(np.concatenate([first, second]))
        self.other = np.searchsorted(self.answers, second)
        own = np.searchsorted(self.answers, first)
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(len(self.answers) + 1))
        self.opens = [order[x:y] for x, y in zip(bounds, bounds[1:])]

    def add(self, totals: np.ndarray, offsets: np.ndarray, held: np.ndarray, wave: np.ndarray, cents: np.ndarray) -> None:
        """Add the weights of some respondents to (wave, audience) totals; sums of whole numbers below 2 ** 53 are exact."""
        place = np.minimum(np.searchsorted(self.answers, held), len(self.answers) - 1)
        known = self.answers[place] == held
        has = np.zeros((len(wave), len(self.answers)), bool)
        has[np.repeat(np.arange(len(wave)), np.diff(offsets))[known], place[known]] = True
        by_wave = np.zeros((len(totals), len(wave)))
        by_wave[wave, np.arange(len(wave))] = cents
        for answer in np.flatnonzero(has.any(axis=0)).tolist():
            opened = self.opens[answer]
            if len(opened):
                rows = np.flatnonzero(has[:, answer])
                totals[:, opened] += (by_wave[:, rows] @ has[rows][:, self.other[opened]].astype(np.float64)).astype(np.int64)


def _audience_sums(index):
    """Weight of each wave and audience over all respondents of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves: dict = {}
        own = index.value
        totals = np.zeros((0, len(own.first)), np.int64)
        for batch in batches:
            lists, names, cents = batch["held"], batch["wavekey"].to_pylist(), batch["cents"].to_numpy(zero_copy_only=False)
            wave = np.array([waves.setdefault(w, len(waves)) for w in names], np.int64)
            totals = np.concatenate([totals, np.zeros((len(waves) - len(totals), len(own.first)), np.int64)])
            offsets, held = lists.offsets.to_numpy(), lists.values.to_numpy()
            for at in range(0, len(wave), RESPONDENTS_AT_ONCE):
                part = slice(at, min(len(wave), at + RESPONDENTS_AT_ONCE))
                ends = offsets[part.start : part.stop + 1]
                own.add(totals, ends - ends[0], held[ends[0] : ends[-1]], wave[part], cents[part])
        for name, k in waves.items():
            some = np.flatnonzero(totals[k])
            columns = [pa.array(own.first[some], pa.int32()), pa.array(own.second[some], pa.int32()), pa.array([name] * len(some), pa.string()), pa.array(totals[k][some])]
            yield pa.record_batch(columns, ["svkey_1", "svkey_2", "wavekey", "cents"])

    return run


def held_answers(predictions: DataFrame, codes: DataFrame, respondents: DataFrame, audiences: DataFrame) -> DataFrame:
    """One row per respondent: uid, wavekey, the sorted answers that occur in an audience, and the weight in hundredths.

    Answers are shuffled once, by respondent, however many audiences there are, and grouped after the shuffle: the tasks that
    read them, whose share grows with the table, sort nothing. Predictions that carry their weight need no join with the respondents.
    """
    weight = ["respondentweight"] if "respondentweight" in predictions.columns else []
    asked = codes.join(either_side(audiences, "svkey"), "svkey", "left_semi")
    named = asked.select(F.col("attribute").alias("attribute_model"), F.col("attribute_value").alias("selected_value"), "svkey")
    rows = predictions.select("uid", "wavekey", "attribute_model", "selected_value", *weight).join(stored(named, "asked-answers"), ["attribute_model", "selected_value"])
    runs = packed_runs(rows.withColumn("held", F.col("svkey").cast("int")), ["uid", "wavekey", *weight], "held")
    dealt = runs.repartition(bucket_count(predictions), "uid", "wavekey")
    answers = F.sort_array(F.array_distinct(F.flatten(F.collect_list("held"))))
    held = dealt.groupBy("uid", "wavekey").agg(answers.alias("held"), *[F.max(w).alias(w) for w in weight])
    cents = (F.col("respondentweight").cast("decimal(18,2)") * 100).cast("long")
    return with_weights(held, respondents).select("wavekey", "held", F.coalesce(cents, F.lit(0)).alias("cents"))


def audience_wave_weights(
    predictions: DataFrame, codes: DataFrame, respondents: DataFrame, audiences: DataFrame, block: int = AUDIENCES_A_BLOCK
) -> DataFrame:
    """Weight per audience and wave of the respondents who hold both answers, for all audiences at once.

    Every respondent becomes one array of held answers. An index from answer to audiences, of at most about
    ``block`` audiences, is sent to the tasks and met with the arrays there; a task sends on one sum for each audience and wave.
    More audiences than that are several passes over the stored arrays. An audience is identified by its two answer keys.
    """
    spark = predictions.sparkSession
    ship(spark)
    pairs = stored(audiences.select(F.col("svkey_1").cast("int").alias("svkey_1"), F.col("svkey_2").cast("int").alias("svkey_2")).distinct(), "audience-pairs")
    blocks = max(1, -(-pairs.count() // block))
    held = held_answers(predictions, codes, respondents, pairs)
    held = stored(held, "held-answers") if blocks > 1 else held
    sums = None
    for i in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("svkey_1", "svkey_2"), F.lit(blocks)) == i).toArrow()
        index = spark.sparkContext.broadcast(AudienceIndex(some["svkey_1"].to_numpy(), some["svkey_2"].to_numpy()))
        part = held.mapInArrow(_audience_sums(index), "svkey_1 int, svkey_2 int, wavekey string, cents long")
        sums = part if sums is None else sums.union(part)
    total = (F.sum("cents").cast("decimal(38,2)") / 100).cast("double")
    return sums.groupBy("svkey_1", "svkey_2", "wavekey").agg(total.alias("wave_audience_weight"))


def audience_shares(
    predictions: DataFrame, codes: DataFrame, respondents: DataFrame, audiences: DataFrame, waves: Sequence[str], iteration: int
) -> DataFrame:
    """Report: one row per audience, share per wave (0 where nobody qualifies), mean over all waves."""
    weights = audience_wave_weights(predictions, codes, respondents, audiences)
    shares = weights.join(wave_totals(respondents), "wavekey").withColumn(
        "share", ratio(F.col("wave_audience_weight"), F.col("wave_total_weight"))
    )
    wide = shares.groupBy("svkey_1", "svkey_2").agg(
        *[F.max(F.when(F.col("wavekey") == w, F.col("share"))).alias(w) for w in waves],
        (F.sum("share") / F.lit(float(len(waves)))).alias("average_imputed_distribution"),
    )
    return (
        _with_id(audiences)
        .join(wide, ["svkey_1", "svkey_2"], "left")
        .na.fill(0.0, [*waves, "average_imputed_distribution"])
        .withColumn("iteration", F.lit(iteration))
    )


def observed_crosstab(predictions: DataFrame, bsm: DataFrame, sakey: int, values: Sequence[int]) -> DataFrame:
    """Respondents per imputed value and observed answer of another question.

    Every respondent becomes one row with the codes of the imputed answers and the observed answers of each wave, so that rows are
    dealt once: neither the meeting of the two tables nor the distinct count moves a row for each imputed answer.
    """
    respondent = F.col("uid").isNotNull() & F.col("wavekey").isNotNull()
    answers = predictions.where(respondent).select("attribute_model", "selected_value")
    names = stored(answers.distinct().withColumn("code", F.monotonically_increasing_id()), "imputed-answers")
    same = F.col("p.attribute_model").eqNullSafe(F.col("n.attribute_model")) & F.col("p.selected_value").eqNullSafe(F.col("n.selected_value"))
    coded = predictions.where(respondent).alias("p").join(names.alias("n"), same).select("uid", "wavekey", "code")
    held = packed_runs(coded, ["uid", "wavekey"], "code").select("uid", F.struct("wavekey", "code").alias("held"))
    asked = bsm.where((F.col("sakey") == sakey) & (F.col("label") == 1.0) & respondent)
    seen = asked.select("uid", F.struct("wavekey", F.col("svkey").alias("observed")).alias("seen"))
    n = bucket_count(predictions)  # a number given is kept: rows so small are not merged into partitions too large to sort in memory
    people = (
        held.unionByName(seen, allowMissingColumns=True).repartition(n, "uid").groupBy("uid")
        .agg(F.collect_list("held").alias("held"), F.collect_list("seen").alias("seen"))
    )
    each = people.where(F.size("held") > 0).select("held", "seen", F.explode(F.array_distinct("seen.observed")).alias("observed"))
    waves = F.transform(F.filter("seen", lambda s: s.observed.eqNullSafe(F.col("observed"))), lambda s: s.wavekey)
    codes = F.flatten(F.transform(F.filter("held", lambda h: F.array_contains(F.col("waves"), h.wavekey)), lambda h: h.code))
    pairs = each.withColumn("waves", waves).select("observed", F.explode(F.array_distinct(codes)).alias("code"))
    counts = pairs.groupBy("code", "observed").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, "code").groupBy("attribute_model", "selected_value").pivot("observed", list(values)).agg(F.sum("n"))
