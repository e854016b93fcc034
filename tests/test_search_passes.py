"""What a round of a sampled fit computes once, and what a search asks once for all its trials."""

import re

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelfill.operators import boosting as ob


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 2), float(i % 7), int(i % 10 < (8 if i % 2 else 2)), i % 5 != 0) for i in range(400)]
    frame = spark.createDataFrame(data, "uid long, a double, b double, y int, is_train boolean")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame).drop("a", "b")


def test_filters_by_gradient_read_a_stored_number(rows, monkeypatch):
    plans = []

    class Tree(ob.DecisionTreeRegressor):
        def fit(self, df):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(df)

    monkeypatch.setattr(ob, "DecisionTreeRegressor", Tree)
    ob.fit_newton_boost(rows, ob.BoostParams(rounds=3, lambda_l2=1.0, bagging_fraction=0.8, top_rate=0.5, other_rate=0.2))
    filters = [line for plan in plans for line in plan.splitlines() if re.search(r"\bFilter\b", line)]
    assert len(plans) == 3 and filters and not any("POWER" in line for line in filters)


def test_qualities_of_all_trials_are_those_of_each(rows, monkeypatch):
    rows = rows.withColumn("uid", F.when(F.col("uid") < 390, F.col("uid")))  # ten rows without a key
    models = {k: ob.fit_newton_boost(rows, ob.BoostParams(rounds=k + 1, max_depth=2, seed=k)) for k in (0, 2)}
    both = ob.qualities(models, 50)
    assert ob.qualities(models, 1000)[2][2] == ob.constancy(models[2], 1000) and both.keys() == models.keys()
    for k, model in models.items():
        assert both[k] == (*map(pytest.approx, ob.test_quality(model)), ob.constancy(model, 50))
    asked, real = [], ob.osc.roc_auc
    monkeypatch.setattr(ob.osc, "roc_auc", lambda *args: asked.append(args) or real(*args))
    ob.random_search(rows, ["a", "b"], 3, ob.BoostParams(rounds=1), space={"max_depth": ("integer", 1, 3)})
    assert len(asked) == 1
