"""Queries for projections, predicates and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.catalog.base import answers_of, predictions_of, query, r6
from panelfill.catalog.sources import COLUMN_OF
from panelfill.functions import survey as fs
from panelfill.operators import labels as ol
from panelfill.operators import shares as osh
from panelfill.operators.joins import in_keys, not_in_keys


def coded(s):
    """Answers with the taxonomy columns that the label rules look at."""
    return s.bsm.join(
        s.taxonomy.select("sakey", "svkey", "multi", "attribute", ol.ALTERNATE, "value"), ["sakey", "svkey", "multi"]
    )


@query("b1_project", "SELECT uid AS respondent, set_uid AS split, ld_1 AS n_lines, ld_2 AS quantity FROM latent")
def b1(s):
    return s.latent.withColumnsRenamed({"uid": "respondent", "set_uid": "split", "ld_1": "n_lines", "ld_2": "quantity"}).drop("ld_0", "ld_3")


@query("b2_binomial_rows", "SELECT uid, svkey, attribute, label AS attribute_value FROM coded WHERE multi OR svkey <> alternate")
def b2(s):
    return ol.binomial_rows(coded(s)).select("uid", "svkey", "attribute", "attribute_value")


@query(
    "b3_multinomial_rows",
    """SELECT uid, svkey, attribute, CAST(value AS DOUBLE) AS attribute_value FROM coded
       WHERE NOT multi AND alternate IS NULL AND label = 1.0""",
)
def b3(s):
    return ol.multinomial_rows(coded(s)).select("uid", "svkey", "attribute", "attribute_value")


@query("b4_code_labels", "SELECT uid, svkey, attribute, label AS attribute_value FROM matrix")
def b4(s):
    return ol.code_labels(coded(s)).select("uid", "svkey", "attribute", "attribute_value")


@query(
    "b5_attribute_value",
    """SELECT b.svkey, coalesce(t.value - 1, 1) AS attribute_value, count(*) AS n
       FROM bsm b JOIN taxonomy t ON t.svkey = b.svkey GROUP BY b.svkey, t.value""",
)
def b5(s):
    return coded(s).select("svkey", fs.attribute_value(F.col("value")).alias("attribute_value")).groupBy(
        "svkey", "attribute_value"
    ).agg(F.count(F.lit(1)).alias("n"))


def zero_coded(s):
    """Answer codes of every respondent and attribute, 0 where there is no answer."""
    everyone = s.respondents.select("uid", F.explode(F.array(*[F.lit(a) for a in COLUMN_OF])).alias("attribute"))
    codes = s.labels.select("uid", "attribute", (F.col("label") + 1).alias("code"))
    return everyone.join(codes, ["uid", "attribute"], "left").select(
        "uid", "attribute", F.coalesce("code", F.lit(0)).alias("code")
    )


@query(
    "b6_decode_zero_missing",
    """SELECT m.attribute_model AS attribute, l.label, l.label IS NOT NULL AS is_labeled, count(*) AS n
       FROM respondents r CROSS JOIN model_sizes m LEFT JOIN coded_labels l ON l.uid = r.uid AND l.attribute = m.attribute_model
       GROUP BY m.attribute_model, l.label""",
)
def b6(s):
    label = fs.decode_zero_missing(F.col("code"))
    return (
        zero_coded(s).select("attribute", label.alias("label"), label.isNotNull().alias("is_labeled"))
        .groupBy("attribute", "label", "is_labeled").agg(F.count(F.lit(1)).alias("n"))
    )


@query("b7_zero_base_labels", "SELECT uid, attribute, CAST(label AS DOUBLE) AS label FROM coded_labels")
def b7(s):
    kind = fs.attribute_kind(F.col("attribute"))
    return s.matrix.select("uid", "attribute", fs.zero_based(F.col("label"), kind).alias("label"))


@query("b8_exclude_attributes", "SELECT uid, attribute, label FROM matrix WHERE attribute NOT IN ('101', '103_1031', '102')")
def b8(s):
    return ol.exclude_attributes(s.matrix, ["101", "103_1031"], target="102").select("uid", "attribute", "label")


@query(
    "b9_in_and_not_in_keys",
    """SELECT CASE WHEN k.attribute IS NULL THEN 'not_in' ELSE 'in' END AS side, m.attribute, m.wavekey, count(*) AS n
       FROM matrix m LEFT JOIN (SELECT DISTINCT attribute FROM model_plan WHERE NOT needs_imputation AND proposed_round = 0) k
         ON k.attribute = m.attribute GROUP BY ALL""",
)
def b9(s):
    ready = s.model_plan.where(~F.col("needs_imputation") & (F.col("proposed_round") == 0)).select("attribute").distinct()
    both = in_keys(s.matrix, ready, "attribute").withColumn("side", F.lit("in")).unionByName(
        not_in_keys(s.matrix, ready, "attribute").withColumn("side", F.lit("not_in"))
    )
    return both.groupBy("side", "attribute", "wavekey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b10_parse_data_slice",
    """SELECT selected_value AS value, set_uid AS "set", attribute_model, count(*) AS n
       FROM predictions GROUP BY selected_value, set_uid, attribute_model""",
)
def b10(s):
    sliced = predictions_of(s).withColumn("data_slice", F.concat_ws("_", "selected_value", "set_uid"))
    return sliced.groupBy(
        fs.slice_value(F.col("data_slice")).alias("value"), fs.slice_set(F.col("data_slice")).alias("set"), "attribute_model"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b11_parse_iteration",
    """SELECT CAST(wavekey AS INTEGER) - 1995 AS iteration, CAST(wavekey AS INTEGER) - 1994 AS next_iteration, count(*) AS n
       FROM predictions GROUP BY wavekey""",
)
def b11(s):
    path = F.concat(
        F.lit("store/iteration_"), F.col("wavekey").cast("int") - 1995, F.lit("/results/"), F.col("attribute_model")
    )
    number = fs.iteration_of(F.col("path"))
    return (
        predictions_of(s).select(path.alias("path"))
        .select(number.alias("iteration"), (number + 1).alias("next_iteration"))
        .groupBy("iteration", "next_iteration").agg(F.count(F.lit(1)).alias("n"))
    )


@query("b12_is_binomial", "SELECT attribute, kind, contains(attribute, '_') AS binomial, count(*) AS n FROM coded_labels GROUP BY ALL")
def b12(s):
    a = F.col("attribute")
    return s.matrix.groupBy("attribute", fs.attribute_kind(a).alias("kind"), fs.is_binomial(a).alias("binomial")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "b13_average_over_waves",
    """SELECT b.svkey, round(sum(x) / (SELECT n FROM n_waves), 6) AS average_share FROM (
         SELECT b.svkey, b.wavekey, CAST(sum(r.respondentweight) AS DOUBLE) / max(t.wave_total_weight) AS x
         FROM bsm b JOIN respondents r ON r.uid = b.uid AND r.wavekey = b.wavekey JOIN totals t ON t.wavekey = b.wavekey
         WHERE b.label = 1.0 GROUP BY b.svkey, b.wavekey) b GROUP BY b.svkey""",
)
def b13(s):
    """Observed answers: waves in which a question was not asked count as 0."""
    chosen = osh.with_weights(s.bsm.where(F.col("label") == 1.0), s.respondents)
    shares = osh.wave_shares(chosen, s.respondents, ["svkey"])
    n = len(osh.wave_list(s.respondents))
    return osh.average_over_waves(shares, ["svkey"], n).select("svkey", r6("average_share"))


@query(
    "b14_share_bounds_flag",
    """SELECT w.svkey, w.wavekey, round(w.wave_share, 6) AS wave_share,
              round(w.wave_share, 6) BETWEEN d.calc_distribution - 0.02 AND d.calc_distribution + 0.02 AS bounded
       FROM wave_shares w JOIN distributions d ON d.svkey = w.svkey""",
)
def b14(s):
    shares = osh.univariate_shares(answers_of(s), s.answer_codes, s.respondents).select("svkey", "wavekey", r6("wave_share"))
    limits = s.distributions.select("svkey", (F.col("calc_distribution") - 0.02).alias("lower"), (F.col("calc_distribution") + 0.02).alias("upper"))
    return shares.join(limits, "svkey").select(
        "svkey", "wavekey", "wave_share", fs.in_bounds(F.col("wave_share"), F.col("lower"), F.col("upper")).alias("bounded")
    )


@query(
    "b15_build_and_parse_key",
    """SELECT DISTINCT p.wavekey, concat_ws('-', a.attribute || '__' || b.attribute, p.sakey_1 || '__' || p.sakey_2, p.svkey_1 || '__' || p.svkey_2) AS pair_key,
              a.attribute AS attribute1, b.attribute AS attribute2, CAST(p.svkey_1 AS VARCHAR) AS svkey_1, CAST(p.svkey_2 AS VARCHAR) AS svkey_2
       FROM answer_pairs p JOIN taxonomy a ON a.svkey = p.svkey_1 JOIN taxonomy b ON b.svkey = p.svkey_2""",
)
def b15(s):
    from panelfill.operators.joins import lookup_both_sides

    named = lookup_both_sides(s.answer_pairs, s.taxonomy, "svkey", ["attribute"])
    keyed = named.select("wavekey", fs.pair_key("attribute1", "attribute2", "sakey_1", "sakey_2", "svkey_1", "svkey_2").alias("pair_key"))
    parts = fs.split_pair_key(F.col("pair_key"))
    return keyed.select("wavekey", "pair_key", *[parts[n].alias(n) for n in ("attribute1", "attribute2", "svkey_1", "svkey_2")])


@query(
    "b16_ratio",
    """SELECT svkey, wavekey, chosen / nullif(missed, 0) AS odds FROM (
         SELECT svkey, wavekey, sum(label) AS chosen, sum(CASE WHEN svkey = 1032 THEN 0 ELSE 1 - label END) AS missed
         FROM bsm GROUP BY svkey, wavekey)""",
)
def b16(s):
    missed = F.when(F.col("svkey") == 1032, F.lit(0.0)).otherwise(1 - F.col("label"))
    return s.bsm.groupBy("svkey", "wavekey").agg(fs.ratio(F.sum("label"), F.sum(missed)).alias("odds"))


def tag(df, **literals):
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


@query("b17_tag", "SELECT svkey, wavekey, round(wave_share, 6) AS wave_share, 0 AS round, 'imputed' AS source FROM wave_shares")
def b17(s):
    shares = osh.univariate_shares(answers_of(s), s.answer_codes, s.respondents)
    return tag(shares.select("svkey", "wavekey", r6("wave_share")), round=0, source="imputed")


@query(
    "b18_fill_missing_waves",
    """SELECT svkey, """
    + ", ".join(f"""coalesce(max(CASE WHEN wavekey = '{y}' THEN n END), 0.0::DOUBLE) AS "{y}" """ for y in range(1995, 2002))
    + """ FROM (SELECT svkey, wavekey, sum(label) AS n FROM bsm GROUP BY svkey, wavekey) GROUP BY svkey""",
)
def b18(s):
    waves = osh.wave_list(s.respondents)
    counts = s.bsm.groupBy("svkey", "wavekey").agg(F.sum("label").alias("wave_share"))
    return osh.fill_missing_waves(osh.pivot_waves(counts, ["svkey"], waves), waves)


@query(
    "b19_casts",
    """SELECT r.uid, CAST(r.respondentweight AS DOUBLE) AS weight, p.attribute_model, p.selected_value
       FROM predictions p JOIN respondents r ON r.uid = p.uid""",
)
def b19(s):
    text = predictions_of(s).select("uid", "attribute_model", F.col("selected_value").cast("double").cast("string").alias("text"))
    weights = s.respondents.select("uid", F.col("respondentweight").cast("double").alias("weight"))
    return text.join(weights, "uid").select(
        "uid", "weight", "attribute_model", F.col("text").try_cast("double").cast("int").alias("selected_value")
    )


@query(
    "b20_tolerance_band",
    """SELECT w.svkey, w.wavekey, abs(w.wave_share - d.prod_distribution) <= 0.05 AS within
       FROM wave_shares w JOIN distributions d ON d.svkey = w.svkey""",
)
def b20(s):
    shares = osh.univariate_shares(answers_of(s), s.answer_codes, s.respondents)
    return shares.join(s.distributions.select("svkey", "prod_distribution"), "svkey").select(
        "svkey", "wavekey", fs.within_tolerance(F.col("wave_share"), F.col("prod_distribution")).alias("within")
    )


@query(
    "b21_share_outliers",
    """SELECT w.svkey, w.wavekey, round(d.prod_distribution, 6) AS production, round(w.wave_share, 6) AS imputed
       FROM wave_shares w JOIN distributions d ON d.svkey = w.svkey WHERE d.prod_distribution BETWEEN 0.45 AND 0.55 AND w.wave_share > 0.75""",
)
def b21(s):
    """Answers with a production share of about one half whose imputed share of a wave is far above it."""
    shares = osh.univariate_shares(answers_of(s), s.answer_codes, s.respondents)
    both = shares.join(s.distributions.select("svkey", F.col("prod_distribution").alias("production")), "svkey")
    return both.where(fs.suspicious_share(F.col("production"), F.col("wave_share"))).select("svkey", "wavekey", r6("production"), r6("wave_share", "imputed"))
