"""What a fit reads more than once is kept."""

from pyspark.ml.feature import VectorAssembler

from panelfill.operators import boosting as ob


def test_a_round_computes_gradients_once(spark, monkeypatch):
    seen = []

    class Tree(ob.DecisionTreeRegressor):
        def fit(self, df):
            seen.append((df, df.storageLevel.useMemory))
            return super().fit(df)

    monkeypatch.setattr(ob, "DecisionTreeRegressor", Tree)
    data = [(i, float(i % 2), float(i % 7), int(i % 10 < (8 if i % 2 else 2)), i % 5 != 0) for i in range(400)]
    frame = spark.createDataFrame(data, "uid long, a double, b double, y int, is_train boolean")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame).drop("a", "b")
    for params in (ob.BoostParams(rounds=2), ob.BoostParams(rounds=2, lambda_l2=1.0, bagging_fraction=0.8, top_rate=0.5, other_rate=0.2)):
        ob.fit_newton_boost(rows, params)
    assert len(seen) == 4 and all(kept for _, kept in seen)
    assert not any(df.storageLevel.useMemory for df, _ in seen)  # and let go after the round
