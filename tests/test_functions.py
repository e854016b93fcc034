import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfill.functions import focal, pvalues, rng
from panelfill.functions import survey as fs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("gamma", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("alpha", [None, 0.3])
def test_focal_derivatives_match_finite_differences(spark, gamma, alpha):
    rows = [(s, y) for s in (-3.0, -0.7, 0.0, 0.4, 2.5) for y in (0, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    y, e = F.col("y"), 1e-4

    def loss(shift):
        return focal.focal_loss(y, focal.sigmoid(F.col("s") + shift), gamma, alpha)

    def grad(shift):
        return focal.focal_grad(y, focal.sigmoid(F.col("s") + shift), gamma, alpha)

    p = focal.sigmoid(F.col("s"))
    out = df.select(
        ((loss(e) - loss(-e)) / (2 * e)).alias("g_num"), focal.focal_grad(y, p, gamma, alpha).alias("g"),
        ((grad(e) - grad(-e)) / (2 * e)).alias("h_num"), focal.focal_hess(y, p, gamma, alpha).alias("h"),
    ).collect()
    for r in out:
        assert r.g == pytest.approx(r.g_num, abs=1e-6)
        assert r.h == pytest.approx(r.h_num, abs=1e-6)


def test_focal_points_at_the_clip(spark):
    df = spark.createDataFrame([(p, y) for p in (1e-15, 0.5, 1 - 1e-15, 0.0, 1.0) for y in (0, 1)], "p double, y int")
    for gamma in (0.0, 0.5, 1.0):
        out = df.select(focal.focal_loss(F.col("y"), F.col("p"), gamma).alias("l"), focal.newton_hess_at(F.col("y"), focal.true_class_probability(F.col("y"), F.col("p")), gamma).alias("h"))
        for r in out.collect():
            assert math.isfinite(r.l) and r.l >= 0
            assert math.isfinite(r.h) and r.h >= focal.HESSIAN_FLOOR


def test_plain_logistic_derivatives(spark):
    out = spark.createDataFrame([(0.2, 1), (0.2, 0)], "p double, y int").select(
        focal.focal_grad(F.col("y"), F.col("p"), 0.0).alias("g"), focal.focal_hess(F.col("y"), F.col("p"), 0.0).alias("h")
    ).collect()
    assert [r.g for r in out] == pytest.approx([-0.8, 0.2])
    assert [r.h for r in out] == pytest.approx([0.16, 0.16])


def test_best_constant_score_is_the_minimum():
    for gamma, alpha in ((0.0, None), (0.7, None), (1.0, 0.2), (0.0, 0.4)):
        p = 1 / (1 + math.exp(-focal.best_constant_score(30, 70, gamma, alpha)))
        best = focal.total_focal_loss(30, 70, p, gamma, alpha)
        grid = [focal.total_focal_loss(30, 70, q / 1000, gamma, alpha) for q in range(1, 1000)]
        assert best <= min(grid) + 1e-6
    assert focal.best_constant_score(30, 70, 0.0) == pytest.approx(math.log(30 / 70))


def test_p_values():
    # closed forms: 2 df is exp(-x/2); 1 df is erfc(sqrt(x/2)); 4 df is exp(-x/2)(1 + x/2)
    for x in (0.01, 0.5, 3.0, 12.0, 60.0):
        assert pvalues.upper_gamma(1.0, x / 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert pvalues.upper_gamma(0.5, x / 2) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert pvalues.upper_gamma(2.0, x / 2) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-11)
    assert pvalues.upper_gamma(3.0, 0.0) == 1.0


def test_p_value_columns(spark):
    row = spark.createDataFrame([(3.841458820694124, 1.0)], "s double, d double").select(
        pvalues.chi2_p_value("s", "d").alias("p"), pvalues.chi2_p_value("s", F.lit(0.0)).alias("none")
    ).first()
    assert row.p == pytest.approx(0.05, rel=1e-9) and row.none is None
    # 1.3581 is the 5 % point of the limiting distribution
    d = 1.3580986393225505 / math.sqrt(50 * 50 / 100)
    assert value(spark, pvalues.kolmogorov_p_value(F.lit(d), F.lit(50), F.lit(50))) == pytest.approx(0.05, rel=1e-6)
    assert value(spark, pvalues.kolmogorov_p_value(F.lit(0.0), F.lit(50), F.lit(50))) == 1.0


def test_hash_uniform_is_the_same_in_tasks_and_columns(spark):
    rows = spark.range(200).select("id", rng.hash_uniform(F.col("id"), "a", 3).alias("u")).collect()
    assert all(r.u == rng.hash_uniform_py(r.id, "a", 3) for r in rows)
    assert 0.4 < sum(r.u for r in rows) / 200 < 0.6


def test_uniform_matrix_and_poisson_counts():
    u = rng.uniform_matrix(np.arange(4000), np.arange(1, 51), 7)
    assert u.shape == (4000, 50) and 0 <= u.min() and u.max() < 1
    assert abs(u.mean() - 0.5) < 0.005
    assert abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.01
    assert abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    counts = rng.poisson_counts(u)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.03
    assert rng.poisson_counts(np.array([0.0, 0.3678, 0.368, 0.9999999999])).tolist()[:3] == [0, 0, 1]
    assert not np.array_equal(u, rng.uniform_matrix(np.arange(4000), np.arange(1, 51), 8))


def test_parsing(spark):
    assert value(spark, fs.iteration_of(F.lit("a/iteration_1/b/iteration_12/x"))) == 12
    assert value(spark, fs.iteration_of(F.lit("a/b"))) is None
    assert value(spark, fs.slice_value(F.lit("3_train"))) == 3
    assert value(spark, fs.slice_set(F.lit("3_train"))) == "train"
    assert value(spark, fs.slice_set(F.lit("1_hyperopt"))) == "hyperopt"
    assert value(spark, fs.model_of(F.lit("s/104_1041/104_1041_predictions"))) == "104_1041"


def test_codes(spark):
    assert value(spark, fs.attribute_value(F.lit(None).cast("int"))) == 1
    assert value(spark, fs.attribute_value(F.lit(4))) == 3
    assert value(spark, fs.decode_zero_missing(F.lit(0))) is None
    assert value(spark, fs.decode_zero_missing(F.lit(3))) == 2
    assert value(spark, fs.ratio(F.lit(1), F.lit(0))) is None


def test_pair_key_round_trip(spark):
    key = fs.pair_key(F.lit("104_1041"), F.lit("102"), F.lit(104), F.lit(102), F.lit(1041), F.lit(1022))
    assert value(spark, key) == "104_1041__102-104__102-1041__1022"
    parts = spark.range(1).select(key.alias("k")).select(*[c.alias(n) for n, c in fs.split_pair_key(F.col("k")).items()]).first()
    assert (parts.attribute1, parts.attribute2, parts.sakey_2, parts.svkey_1) == ("104_1041", "102", "102", "1041")


def test_winners(spark):
    ties = F.array(F.lit(0.3), F.lit(0.4), F.lit(0.4))
    assert value(spark, fs.argmax_class(ties)) == 1
    assert value(spark, fs.apply_multipliers(ties, F.array(F.lit(2.0), F.lit(1.0), F.lit(1.4)))) == 0
    assert value(spark, fs.observed_wins(F.lit(None).cast("int"), F.lit(2))) == 2
    assert value(spark, fs.observed_wins(F.lit(0), F.lit(2))) == 0
    assert value(spark, fs.mean_with_zeros([F.lit(0.6), F.lit(None).cast("double"), F.lit(0.3)])) == pytest.approx(0.3)


def test_poisson_matrix_gives_the_counts_of_the_uniform_draws():
    keys, columns = np.arange(5000, 9000), np.arange(1, 1001)
    assert np.array_equal(rng.poisson_matrix(keys, columns, 3), rng.poisson_counts(rng.uniform_matrix(keys, columns, 3)))
    # a table entry holds for the first and the last draw of its 16 bits
    whole = np.flatnonzero(rng._COUNTS != rng.SPLIT)
    for low in (0, (1 << 16) - 1):
        assert np.array_equal(rng._COUNTS[whole], rng.poisson_counts(((whole << 16) + low) / 2**32))


def test_poisson_matrix_takes_less_than_half_the_time():
    import time

    keys, columns = np.arange(64), np.arange(1, 1001)

    def best(f):
        taken = []
        for _ in range(15):
            start = time.perf_counter()
            f()
            taken.append(time.perf_counter() - start)
        return min(taken)

    plain = best(lambda: rng.poisson_counts(rng.uniform_matrix(keys, columns, 0)))
    assert best(lambda: rng.poisson_matrix(keys, columns, 0)) < plain / 2
