import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfill.operators import association, blocks, joins, running, sampling, scores, shares
from panelfill.operators import labels as ol
from panelfill.operators.audiences import audience_shares, audience_wave_weights, held_answers

TAXONOMY = "sakey int, svkey int, multi boolean, alternate_svkey_binary_single int, attribute string, value int"


def test_label_rules_with_null_alternates(spark):
    rows = [
        # uid, svkey, multi, alternate, value, label
        (1, 11, True, None, None, 0.0), (2, 11, True, 11, None, 1.0), (3, 11, True, 12, None, 1.0),
        (4, 11, False, None, 3, 1.0), (5, 11, False, 11, None, 1.0), (6, 11, False, 12, None, 0.0),
        (7, 11, False, None, 3, 0.0),
    ]
    df = spark.createDataFrame(rows, "uid int, svkey int, multi boolean, alternate_svkey_binary_single int, value int, label double")
    got = {r.uid: r.attribute_value for r in ol.code_labels(df).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: 3.0, 6: 0.0}
    two = ol.binomial_rows(df).unionByName(ol.multinomial_rows(df))
    assert {r.uid: r.attribute_value for r in two.collect()} == got


def test_attribute_matrix_drops_unknown_respondents(spark):
    bsm = spark.createDataFrame([(u, "w", 1, 11, True, 1.0) for u in (1, 2, 3)], "uid long, wavekey string, sakey int, svkey int, multi boolean, label double")
    taxonomy = spark.createDataFrame([(1, 11, True, None, "1_11", None)], TAXONOMY)
    people = spark.createDataFrame([(1, "train"), (1, "train"), (3, "test")], "uid long, set_uid string")
    got = sorted((r.uid, r.set_uid, r.label) for r in ol.attribute_matrix(bsm, taxonomy, people).collect())
    assert got == [(1, "train", 1.0), (3, "test", 1.0)]


def test_running_totals_match_a_loop_under_skew(spark):
    rng = np.random.default_rng(0)
    rows = {("hot", float(v)) for v in rng.normal(size=3000) ** 3} | {("cold", float(v)) for v in rng.random(20)} | {("one", 0.5)}
    table = [(g, v, int(i % 7)) for i, (g, v) in enumerate(sorted(rows))]
    df = spark.createDataFrame(table, "g string, v double, n int")
    for buckets in (1, 8, 64):
        out = running.running_totals(running.range_buckets(df, "v", buckets), ["g"], ["v"], {"n": "below"}).collect()
        assert len(out) == len(table)
        want, total = {}, {}
        for g, v, n in sorted(table):
            want[g, v] = total.get(g, 0)
            total[g] = total.get(g, 0) + n
        assert all(r.below == want[r.g, r.v] and r.all_n == total[r.g] for r in out)


def test_buckets_stay_small_when_one_group_dominates(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), (F.col("id") / 2e9).alias("v"))
    sizes = running.range_buckets(df, "v", 50).groupBy("g", "_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 20000 / 50 * 2


def test_ranges_follow_the_order_and_keep_ties_together(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("v"))
    out = running.range_buckets(df, "v", 30).groupBy("_bucket").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_bucket").collect()
    assert len(out) > 20 and all(a.high < b.low for a, b in zip(out, out[1:]))


def brute_auc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    rows = [("m", 0, "test", int(rng.random() < 0.4), round(float(rng.random()), 2)) for _ in range(400)]
    rows += [("ties", 0, "test", i % 2, 0.5) for i in range(10)] + [("onesided", 0, "test", 1, 0.1 * i) for i in range(5)]
    return rows, spark.createDataFrame(rows, "attribute_model string, value int, set_uid string, y int, p double")


def test_auc_against_all_pairs(scored):
    rows, df = scored
    for buckets in (1, 16):
        got = {r.attribute_model: r.roc_score for r in scores.roc_auc(df, buckets=buckets).collect()}
        for model in got:
            mine = [r for r in rows if r[0] == model]
            want = brute_auc([r[3] for r in mine], [r[4] for r in mine])
            assert got[model] == (pytest.approx(want) if want is not None else None)
    assert got["ties"] == 0.5 and got["onesided"] is None


def test_roc_curve_and_best_thresholds(scored):
    rows, df = scored
    curve = scores.roc_curve(df, buckets=8)
    mine = [r for r in rows if r[0] == "m"]
    pos, neg = sum(r[3] for r in mine), sum(1 - r[3] for r in mine)

    def counts(t):
        return sum(r[3] for r in mine if r[4] >= t), sum(1 - r[3] for r in mine if r[4] >= t)

    def mcc(t):
        tp, fp = counts(t)
        fn, tn = pos - tp, neg - fp
        scale = ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
        return (tp * tn - fp * fn) / scale if scale else 0.0

    points = [r for r in curve.collect() if r.attribute_model == "m"]
    distinct = sorted({r[4] for r in mine})
    assert sorted(r.threshold for r in points) == pytest.approx([*distinct, max(distinct) + 1])
    for r in points:
        assert (r.tp, r.fp) == counts(r.threshold)
    best = {r.attribute_model: r for r in scores.best_mcc_threshold(curve).collect()}
    top = max(round(mcc(t), 9) for t in distinct)
    assert best["m"].mcc == pytest.approx(top)
    assert best["m"].threshold == max(t for t in distinct if round(mcc(t), 9) == top)
    # nothing separates equal scores: the threshold above them all wins the tie
    assert best["ties"].mcc == 0 and best["ties"].threshold == 1.5
    youden = {r.attribute_model: r.youden for r in scores.best_youden_threshold(curve).collect()}
    assert youden["m"] == pytest.approx(max(counts(t)[0] / pos - counts(t)[1] / neg for t in distinct), abs=1e-8)


def test_class_scores_when_a_class_is_missing_from_a_split(spark):
    rows = [(i, "7", s, y, [0.2, 0.8]) for i, (s, y) in enumerate([("train", 0), ("train", 1), ("test", 0), ("test", 0)])]
    df = spark.createDataFrame(rows, "uid long, attribute_model string, set_uid string, label int, probs array<double>")
    got = {(r.value, r.set_uid): r.roc_score for r in scores.roc_auc(scores.class_scores(df)).collect()}
    assert set(got) == {(0, "train"), (1, "train"), (0, "test"), (1, "test")}
    assert got[1, "test"] is None and got[0, "train"] == 0.5


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 1.0)], "g string, y int, p double")
    got = {r.g: r.log_loss for r in scores.log_loss(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(-np.log(1e-15)) and got["b"] == pytest.approx(0.0, abs=1e-12)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.integers(0, 50, 997) / 7, "b": rng.normal(size=12), "c": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    for buckets in (1, 16):
        for r in association.exact_quantiles(df, "v", ["g"], [0.025, 0.5, 0.975], buckets).collect():
            assert [r.q2_5, r.q50, r.q97_5] == pytest.approx(np.quantile(data[r.g], [0.025, 0.5, 0.975]).tolist())


def test_ks_statistic_by_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0.3, 1, 300).round(2), rng.normal(0, 1, 200).round(2)
    df = spark.createDataFrame([("x", float(v), True) for v in a] + [("x", float(v), False) for v in b], "f string, v double, flag boolean")
    got = association.ks_two_sample(df, "v", "flag", ["f"], buckets=8).first()
    grid = np.concatenate([a, b])
    want = max(abs((a <= t).mean() - (b <= t).mean()) for t in grid)
    assert got.statistic == pytest.approx(want) and (got.n1, got.n0) == (300, 200)


def test_chi2_by_hand(spark):
    features = spark.createDataFrame([(1, "f", 2.0), (2, "f", 1.0), (3, "f", 0.0), (4, "f", 3.0), (9, "f", 9.0)], "uid long, feature string, value double")
    labels = spark.createDataFrame([(1, "m", 0), (2, "m", 0), (3, "m", 1), (4, "m", 1), (5, "m", 1), (6, "m", None)], "uid long, attribute_model string, label int")
    got = association.chi2_scores(features, labels).first()
    # total 6; expected 2.4 and 3.6, observed 3 and 3
    assert got.chi2 == pytest.approx(0.36 / 2.4 + 0.36 / 3.6)
    assert got.p_value == pytest.approx(0.6170750774519738, rel=1e-9)


def test_block_products_of_many_models(spark):
    """3,000 models: blocks against a plain double loop, and no row for each answer and model."""
    rng = np.random.default_rng(7)
    features = {(u, f"f{int(f)}"): float(rng.integers(0, 4)) for u in range(120) for f in rng.choice(90, 12, replace=False)}
    labels = {(u, f"m{int(m)}"): int(rng.integers(0, 2)) for u in range(0, 130, 2) for m in rng.choice(3000, 40, replace=False)}
    want = {}
    for (u, f), v in features.items():
        for (w, m), y in labels.items():
            if u == w:
                want[m, y, f] = want.get((m, y, f), 0.0) + v
    left = spark.createDataFrame([(u, f, v) for (u, f), v in features.items()], "uid long, feature string, value double")
    right = spark.createDataFrame([(u, m, y) for (u, m), y in labels.items()], "uid long, attribute_model string, label int")
    got = {(r.attribute_model, r.label, r.feature): r.observed for r in association.class_totals(left, right).collect()}
    assert got == pytest.approx(want)
    rows, cols = blocks.numbered(left, "feature", "row"), blocks.numbered(right.select(F.struct("attribute_model", "label").alias("c")), "c", "col")
    x = left.join(rows, "feature").select("uid", "row", "value")
    y = right.select("uid", F.struct("attribute_model", "label").alias("c")).join(cols, "c").select("uid", "col")
    names = {r.row: r.feature for r in rows.collect()}, {r.col: tuple(r.c) for r in cols.collect()}
    small = blocks.block_product(x, y, 130, size=64, people_a_block=50)
    assert {(*names[1][r.col], names[0][r.row]): r.total for r in small.collect()} == pytest.approx(want)


def test_closest_features(spark):
    rows = [("a", f"f{i}", 0.1 * (i % 5), 0.5 + i) for i in range(20)] + [("b", "z", 0.2, 0.1), ("b", "y", 0.2, 0.1), ("b", "n", None, 0.0)]
    ks = spark.createDataFrame(rows, "g string, feature string, p_value double, statistic double")
    got = sorted((r.g, r["rank"], r.feature) for r in association.closest_features(ks, 3, ["g"]).collect())
    assert got == [("a", 1, "f4"), ("a", 2, "f9"), ("a", 3, "f14"), ("b", 1, "y"), ("b", 2, "z")]


RESPONDENTS = [(1, "w1", 2.0), (2, "w1", 2.0), (3, "w2", 1.0), (4, "w2", 3.0), (5, "w3", 5.0)]


def survey(spark):
    people = spark.createDataFrame(RESPONDENTS, "uid long, wavekey string, w double").select("uid", "wavekey", F.col("w").cast("decimal(18,2)").alias("respondentweight"))
    codes = spark.createDataFrame([(1, 11, False, "1", 0), (1, 12, False, "1", 1), (2, 21, True, "2_21", 1)], "sakey int, svkey int, multi boolean, attribute string, attribute_value int")
    rows = [(1, "w1", "1", 0), (2, "w1", "1", 1), (3, "w2", "1", 0), (4, "w2", "1", 0), (1, "w1", "2_21", 1), (3, "w2", "2_21", 0), (4, "w2", "2_21", 1)]
    predictions = spark.createDataFrame(rows, "uid long, wavekey string, attribute_model string, selected_value int")
    return predictions, codes, people


def test_univariate_report_counts_empty_waves_as_zero(spark):
    predictions, codes, people = survey(spark)
    got = {r.svkey: r for r in shares.univariate_report(predictions, codes, people, 3).collect()}
    assert (got[11]["w1"], got[11]["w2"], got[11]["w3"]) == (0.5, 1.0, None)
    assert got[11].average_imputed_distribution == pytest.approx(0.5)
    assert got[12].average_imputed_distribution == pytest.approx(0.5 / 3)
    assert got[21].average_imputed_distribution == pytest.approx((0.5 + 0.75) / 3)
    assert got[11]["round"] == 3
    # predictions that carry the weight give the same without the join
    carried = predictions.join(people, ["uid", "wavekey"])
    again = {r.svkey: r for r in shares.univariate_report(carried, codes, people, 3).collect()}
    assert again == got


def test_class_histogram_has_every_class(spark):
    answers = spark.createDataFrame([("m", "w1", 0, 1.0), ("m", "w1", 2, 3.0), ("m", "w2", 1, 2.0)], "attribute_model string, wavekey string, v int, weight double")
    classes = spark.createDataFrame([("m", 4)], "attribute_model string, num_class int")
    got = {(r.wavekey, r.v): r.share for r in shares.class_histogram(answers, ["w1", "w2", "w3"], "v", "attribute_model", classes).collect()}
    assert got == {("w1", 0): 0.25, ("w1", 1): 0.0, ("w1", 2): 0.75, ("w1", 3): 0.0, ("w2", 0): 0.0, ("w2", 1): 1.0, ("w2", 2): 0.0, ("w2", 3): 0.0}


def test_audiences_need_both_answers(spark):
    predictions, codes, people = survey(spark)
    pairs = spark.createDataFrame(
        [("1", "2_21", 1, 2, 11, 21), ("1", "1", 1, 1, 11, 12), ("1", "2_21", 1, 2, 12, 21)],
        "attribute1 string, attribute2 string, sakey_1 int, sakey_2 int, svkey_1 int, svkey_2 int",
    )
    for table in (predictions, predictions.join(people, ["uid", "wavekey"])):
        got = {(r.svkey_1, r.svkey_2): r for r in audience_shares(table, codes, people, pairs, ["w1", "w2", "w3"], 1).collect()}
        assert (got[11, 21]["w1"], got[11, 21]["w2"], got[11, 21]["w3"]) == (0.5, 0.75, 0.0)
        assert got[11, 21].average_imputed_distribution == pytest.approx(1.25 / 3)
        # two answers of one single-choice question exclude each other; nobody holds the third pair
        assert got[11, 12].average_imputed_distribution == 0.0 and got[12, 21].average_imputed_distribution == 0.0


def test_audiences_of_many_answers_like_a_double_loop(spark):
    rng = np.random.default_rng(5)
    codes = [(1, 100 + k, False, str(k), v) for k in range(12) for v in range(1)] + [(1, 200 + k, False, str(k), 1) for k in range(12)]
    codes = spark.createDataFrame(codes, "sakey int, svkey int, multi boolean, attribute string, attribute_value int")
    people = [(u, f"w{u % 3}", float(rng.integers(1, 10**7)) / 100) for u in range(300)]
    answers = [(u, w, str(k), int(rng.integers(0, 2))) for u, w, _ in people for k in range(12) if rng.random() < 0.6]
    respondents = spark.createDataFrame(people, "uid long, wavekey string, w double").select("uid", "wavekey", F.col("w").cast("decimal(18,2)").alias("respondentweight"))
    predictions = spark.createDataFrame(answers, "uid long, wavekey string, attribute_model string, selected_value int")
    keys = [*range(100, 112), *range(200, 212)]
    pairs = [(a, b) for a in keys for b in keys if a <= b] + [(999, 100)]
    held = {}
    for u, w, k, v in answers:
        held.setdefault(u, set()).add((200 if v else 100) + int(k))
    want = {}
    for u, w, x in people:
        for a, b in pairs:
            if {a, b} <= held.get(u, set()):
                want[a, b, w] = want.get((a, b, w), 0) + round(100 * x)
    audiences = spark.createDataFrame(pairs, "svkey_1 int, svkey_2 int")
    for size in (1 << 16, 100):
        got = audience_wave_weights(predictions, codes, respondents, audiences, size).collect()
        assert {(r.svkey_1, r.svkey_2, r.wavekey): round(100 * r.wave_audience_weight) for r in got} == want
    # what is shuffled for a respondent does not depend on the number of audiences
    one = held_answers(predictions, codes, respondents, audiences).groupBy().agg(F.count("*"), F.sum(F.size("held"))).first()
    assert tuple(one) == (len(held), sum(map(len, held.values())))


def test_shuffled_is_a_permutation(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("x"))
    a = {r.id: r.position for r in sampling.shuffled(df, ["id"], 4).collect()}
    assert sorted(a.values()) == list(range(3000)) and a == {r.id: r.position for r in sampling.shuffled(df.repartition(11), ["id"], 4).collect()}
    import hashlib

    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"{i}|4".encode()).hexdigest(), i))
    assert [order[a[i]] for i in range(3000)] == list(range(3000))
    assert sampling.shuffled(df.limit(0), ["id"]).count() == 0


def test_key_pairs_and_first_match(spark):
    df = spark.createDataFrame([("x", [3, 1, 2, 1]), ("y", [5])], "a string, keys array<int>")
    got = sorted((r.key_1, r.key_2, r.expression) for r in joins.key_pairs(df).collect())
    assert got == [(a, b, f"A{a} AND A{b}") for a, b in itertools.combinations([1, 2, 3], 2)]
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "late", 9), (1, "early", 3)], "k int, name string, o int")
    got = {r.k: r.name for r in joins.first_match(left, right, ["k"], ["o"]).collect()}
    assert got == {1: "early", 2: None}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = [r.id for r in sampling.random_sample(df, 20, ["id"], 1).collect()]
    b = [r.id for r in sampling.random_sample(df.repartition(13), 20, ["id"], 1).collect()]
    assert a == b and len(set(a)) == 20
    assert [r.id for r in sampling.random_sample(df, 20, ["id"], 2).collect()] != a
    picked = sampling.pick_covariates(spark.createDataFrame([(c,) for c in "abcdef"], "attribute string"), "a", ["b"], 3, 5)
    names = [r.attribute for r in picked.collect()]
    assert len(names) == 4 and names.count("a") == 1 and "b" not in names


def test_known_respondents_are_not_broadcast(spark):
    """However small their files look: a list of respondents grows with the survey."""
    from panelfill.operators.labels import known_respondents
    from panelfill.session import stored

    people = stored(spark.range(2000).selectExpr("id AS uid", "'train' AS set_uid"), "people")
    answers = spark.range(4000).selectExpr("id % 3000 AS uid", "id AS svkey")
    kept = known_respondents(answers, people)
    assert kept.count() == 3000 and kept.columns == ["uid", "svkey", "set_uid"]
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
