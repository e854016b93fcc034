"""What a step of a chain computes once."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelfill.functions.rng import hash_uniform
from panelfill.operators import chained as och
from panelfill.operators.features import FeatureSpec


def test_a_draw_takes_its_hash_once(spark):
    probs = F.array(*[F.col("id") * 0.0 + p for p in (0.2, 0.5, 0.3)])
    drawn = spark.range(300).select("id", hash_uniform(F.col("id"), 7).alias("u"), och.draw_class(probs, hash_uniform(F.col("id"), 7)).alias("d"))
    plan = drawn.select("d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.index("md5(") < plan.index("lambdafunction(")  # not inside the loop over the classes
    assert all(r.d == (r.u >= 0.2) + (r.u >= 0.7) for r in drawn.collect())


def test_a_step_knows_its_classes(spark):
    variables, fixed = och.Variables({"a": 5}), FeatureSpec({"q": 3})
    rows = spark.range(90).select(F.col("id").alias("uid"), array_to_vector(F.array((F.col("id") % 3).cast("double"))).alias("features"), F.array((F.col("id") % 3).cast("int")).alias("labels"))
    after, model = och.mice_step(rows.withColumn("values", F.col("labels")), variables, 0, fixed, 1, 3, trees=2, depth=2)
    assert model.numClasses == 5  # from the variable, not counted from the labels, of which there are three
    assert after.where("values[0] > 2 OR values[0] IS NULL").isEmpty()
