"""Queries for joins, reshaping, set operations, ordering and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelfill.catalog.base import hashed, predictions_of, query, r6
from panelfill.catalog.expressions import coded
from panelfill.operators import joins as oj
from panelfill.operators import labels as ol
from panelfill.operators import sampling as osa
from panelfill.session import stored


@query(
    "c1_inner_join_shared_names",
    """SELECT b.uid, b.wavekey, b.svkey, t.attribute, b.label FROM bsm b
       JOIN taxonomy t ON t.sakey = b.sakey AND t.svkey = b.svkey AND t.multi = b.multi""",
)
def c1(s):
    return coded(s).select("uid", "wavekey", "svkey", "attribute", "label")


@query(
    "c2_join_results_to_codes",
    """SELECT p.uid, p.attribute_model, p.selected_value, c.sakey, c.svkey FROM predictions p
       JOIN answer_codes c ON c.attribute = p.attribute_model AND c.attribute_value = p.selected_value""",
)
def c2(s):
    return oj.with_answer_codes(predictions_of(s), s.answer_codes).select("uid", "attribute_model", "selected_value", "sakey", "svkey")


@query(
    "c3_lookup_both_sides",
    """SELECT p.wavekey, p.svkey_1, p.svkey_2, a.attribute AS attribute1, b.attribute AS attribute2
       FROM answer_pairs p JOIN taxonomy a ON a.svkey = p.svkey_1 JOIN taxonomy b ON b.svkey = p.svkey_2""",
)
def c3(s):
    return oj.lookup_both_sides(s.answer_pairs, s.taxonomy, "svkey", ["attribute"]).select(
        "wavekey", "svkey_1", "svkey_2", "attribute1", "attribute2"
    )


@query(
    "c4_left_join_labels",
    """SELECT f.uid, f.ld_1, l.label FROM latent f LEFT JOIN (SELECT uid, label FROM coded_labels WHERE attribute = '102') l ON l.uid = f.uid""",
)
def c4(s):
    labels = s.labels.where(F.col("attribute") == "102").select("uid", "label")
    return s.latent.select("uid", "ld_1").join(labels, "uid", "left")


@query(
    "c5_full_outer_labels",
    """SELECT uid, set_uid, max(CASE WHEN attribute = '102' THEN label END) AS a102,
              max(CASE WHEN attribute = '104_1041' THEN label END) AS a104_1041,
              max(CASE WHEN attribute = '104_1043' THEN label END) AS a104_1043
       FROM coded_labels WHERE attribute IN ('102', '104_1041', '104_1043') GROUP BY uid, set_uid""",
)
def c5(s):
    frames = [
        s.labels.where(F.col("attribute") == a).select("uid", "set_uid", F.col("label").alias(f"a{a}"))
        for a in ("102", "104_1041", "104_1043")
    ]
    return oj.join_labels(frames, ["uid", "set_uid"])


@query(
    "c6_known_respondents",
    """SELECT b.uid, l.set_uid, b.svkey FROM bsm b JOIN (SELECT DISTINCT uid, set_uid FROM latent WHERE ld_1 IS NOT NULL) l ON l.uid = b.uid""",
)
def c6(s):
    people = s.latent.where(F.col("ld_1").isNotNull())
    return ol.known_respondents(s.bsm, people).select("uid", "set_uid", "svkey")


@query("c7_anti_join", "SELECT uid, wavekey FROM respondents WHERE uid NOT IN (SELECT uid FROM matrix WHERE attribute = '102')")
def c7(s):
    return s.respondents.select("uid", "wavekey").join(s.matrix.where(F.col("attribute") == "102"), "uid", "left_anti")


@query(
    "c9_first_match",
    """SELECT d.svkey, round(d.calc_distribution, 6) AS calc_distribution, f.wavekey AS first_wave, f.n FROM distributions d
       LEFT JOIN (SELECT svkey, wavekey, n FROM (SELECT svkey, wavekey, count(*) AS n, row_number() OVER (PARTITION BY svkey ORDER BY wavekey) AS i
                  FROM bsm GROUP BY svkey, wavekey) WHERE i = 1) f ON f.svkey = d.svkey""",
)
def c9(s):
    by_wave = s.bsm.groupBy("svkey", F.col("wavekey").alias("first_wave")).agg(F.count(F.lit(1)).alias("n"))
    left = s.distributions.select("svkey", r6("calc_distribution"))
    return oj.first_match(left, by_wave, ["svkey"], ["first_wave"])


@query(
    "c11_common_questions",
    """SELECT b.sakey, count(DISTINCT b.uid) AS n_respondents FROM bsm b
       WHERE b.sakey IN (SELECT sakey FROM (SELECT sakey_1 AS sakey, sakey_2 AS other, wavekey FROM answer_pairs
                                           UNION ALL SELECT sakey_2, sakey_1, wavekey FROM answer_pairs)
                         GROUP BY sakey, other HAVING count(DISTINCT wavekey) > 1)
         AND b.sakey IN (SELECT sakey FROM univariate)
       GROUP BY b.sakey""",
)
def c11(s):
    from panelfill.catalog.reports import univariate
    from panelfill.operators.audiences import either_side, question_pairs_on_waves

    asked = either_side(question_pairs_on_waves(s.answer_pairs), "sakey")
    imputed = univariate(s).select("sakey").distinct()
    kept = oj.in_keys(s.bsm, stored(oj.common_keys(asked, imputed), "common-questions"), "sakey")
    return kept.groupBy("sakey").agg(F.countDistinct("uid").alias("n_respondents"))


@query(
    "e1_unpivot",
    """SELECT uid, 'ld_0' AS feature, ld_0 AS value FROM latent UNION ALL SELECT uid, 'ld_1', ld_1 FROM latent
       UNION ALL SELECT uid, 'ld_2', ld_2 FROM latent UNION ALL SELECT uid, 'ld_3', ld_3 FROM latent""",
)
def e1(s):
    return s.latent.unpivot(["uid"], ["ld_0", "ld_1", "ld_2", "ld_3"], "feature", "value")


@query(
    "e2_union_all",
    """SELECT uid, attribute, label AS attribute_value FROM coded WHERE multi OR svkey <> alternate
       UNION ALL SELECT uid, attribute, value FROM coded WHERE NOT multi AND alternate IS NULL AND label = 1.0""",
)
def e2(s):
    rows = coded(s)
    return ol.binomial_rows(rows).unionByName(ol.multinomial_rows(rows)).select("uid", "attribute", "attribute_value")


@query(
    "e3_append_iterations",
    """SELECT i.iteration, p.attribute_model, CASE WHEN i.iteration = 0 THEN p.max_prediction ELSE p.selected_value END AS answer, count(*) AS n
       FROM predictions p CROSS JOIN (VALUES (0), (1)) i(iteration) GROUP BY ALL""",
)
def e3(s):
    """Frames of two iterations appended by name; columns in another order line up."""
    p = predictions_of(s)
    first = p.select(F.lit(0).alias("iteration"), "attribute_model", F.col("max_prediction").alias("answer"))
    second = p.select(F.col("selected_value").alias("answer"), "attribute_model", F.lit(1).alias("iteration"))
    return first.unionByName(second).groupBy("iteration", "attribute_model", "answer").agg(F.count(F.lit(1)).alias("n"))


@query("e4_union_distinct", "SELECT svkey_1 AS svkey FROM answer_pairs UNION SELECT svkey_2 FROM answer_pairs")
def e4(s):
    from panelfill.operators.audiences import either_side

    return either_side(s.answer_pairs, "svkey")


@query(
    "e5_intersect",
    """SELECT uid, set_uid FROM matrix WHERE attribute = '102' INTERSECT SELECT uid, set_uid FROM matrix WHERE attribute = '104_1041'""",
)
def e5(s):
    of = lambda a: s.matrix.where(F.col("attribute") == a).select("uid", "set_uid")
    return oj.common_keys(of("102"), of("104_1041"))


@query("e6_sort", "SELECT sakey, svkey, uid, label FROM matrix ORDER BY sakey, svkey, uid")
def e6(s):
    return s.matrix.select("sakey", "svkey", "uid", "label").orderBy("sakey", "svkey", "uid")


@query(
    "e7_random_top_n",
    f"SELECT DISTINCT sakey_1, svkey_1, sakey_2, svkey_2 FROM answer_pairs ORDER BY {hashed('sakey_1', 'svkey_1', 'sakey_2', 'svkey_2', '7')} LIMIT 5000"
    .replace("SELECT DISTINCT", "SELECT * FROM (SELECT DISTINCT").replace(" ORDER BY", ") ORDER BY"),
)
def e7(s):
    keys = ["sakey_1", "svkey_1", "sakey_2", "svkey_2"]
    return osa.random_sample(s.answer_pairs.select(*keys).distinct(), 5000, keys, seed=7)


@query("e8_sample_respondents", f"SELECT uid, wavekey FROM respondents ORDER BY {hashed('uid', '8')} LIMIT 2000")
def e8(s):
    return osa.random_sample(s.respondents.select("uid", "wavekey"), 2000, ["uid"], seed=8)


@query(
    "e8_shuffled",
    f"SELECT uid, wavekey, row_number() OVER (ORDER BY {hashed('uid', '8')}, uid) - 1 AS position FROM respondents",
)
def e8_shuffled(s):
    """All respondents in a random order."""
    return osa.shuffled(s.respondents.select("uid", "wavekey"), ["uid"], seed=8).select("uid", "wavekey", "position")


@query(
    "e9_pick_covariates",
    f"""SELECT attribute FROM (SELECT attribute FROM (SELECT DISTINCT attribute FROM model_plan WHERE n_respondents > 0 AND needs_imputation)
          WHERE attribute <> '102' ORDER BY {hashed('attribute', '9')} LIMIT 2)
        UNION ALL SELECT '102'""",
)
def e9(s):
    plan = s.model_plan.where((F.col("n_respondents") > 0) & F.col("needs_imputation"))
    return osa.pick_covariates(plan, "102", ["101", "103_1031"], 2, seed=9)
