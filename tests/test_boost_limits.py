"""Limits of a tree are those the parameters name."""

import pytest
from pyspark.ml.feature import VectorAssembler

from panelfill.operators import boosting as ob


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 2), int(i % 10 < (8 if i % 2 else 2)), i % 5 != 0) for i in range(400)]
    frame = spark.createDataFrame(data, "uid long, x double, y int, is_train boolean")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(frame).drop("x")


def nodes(rows, **limits):
    params = ob.BoostParams(rounds=1, min_data_in_leaf=1, **limits)
    return ob.fit_newton_boost(rows, params).steps[0].tree.numNodes


def test_minimum_gain_is_a_sum_over_rows(rows):
    assert nodes(rows, min_gain_to_split=1.0) == 3
    assert nodes(rows, min_gain_to_split=1e6) == 1


def test_minimum_hessian_above_half_of_the_total_means_no_split(rows):
    assert nodes(rows, min_sum_hessian_in_leaf=1e-3) == 3
    assert nodes(rows, min_sum_hessian_in_leaf=1e6) == 1


def test_leaf_limit_is_never_exceeded():
    for leaves in (2, 3, 5, 31, 600):
        assert 2 ** ob.BoostParams(num_leaves=leaves, max_depth=30).depth <= leaves


def test_bagging_without_rows_is_an_error(rows):
    with pytest.raises(ValueError):
        nodes(rows, bagging_fraction=0.0)
