import numpy as np
from pyspark.sql import functions as F

from panelfill.operators.audiences import held_answers, observed_crosstab
from panelfill.operators.runs import packed_runs


def crosstab_tables(spark):
    rng = np.random.default_rng(8)
    waves = ["w1", "w2"]
    imputed = [
        (u, w, f"m{k}", int(rng.integers(0, 3)) if rng.random() < 0.9 else None)
        for u in range(200) for w in waves for k in range(4) if rng.random() < 0.8
    ]
    imputed += imputed[:50] + [(None, "w1", "m0", 1), (3, None, "m0", 1), (4, "w1", None, 1)]
    chosen = [(u, w, 7, int(rng.integers(70, 75)), float(rng.integers(0, 2))) for u in range(220) for w in waves for _ in range(2)]
    chosen += [(4, "w1", 7, 70, 1.0), (5, "w1", 7, None, 1.0), (None, "w1", 7, 70, 1.0), (6, "w1", 8, 70, 1.0)]
    return (
        imputed, chosen, spark.createDataFrame(imputed, "uid long, wavekey string, attribute_model string, selected_value int"),
        spark.createDataFrame(chosen, "uid long, wavekey string, sakey int, svkey int, label double"),
    )


def test_crosstab_counts_a_respondent_once(spark):
    imputed, chosen, predictions, bsm = crosstab_tables(spark)
    met = {(m, v, o, u) for u, w, m, v in imputed for x, y, s, o, label in chosen if u is not None and (u, w) == (x, y) and w and s == 7 and label == 1.0}
    want = {(m, v): tuple(sum((m, v, o) == k[:3] for k in met) or None for o in range(70, 74)) for m, v, _, _ in met}
    assert {(r[0], r[1]): tuple(r)[2:] for r in observed_crosstab(predictions, bsm, 7, [70, 71, 72, 73]).collect()} == want


def test_crosstab_deals_respondents_once(spark):
    _, _, predictions, bsm = crosstab_tables(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # code books are broadcast, respondents are not
    try:
        plan = observed_crosstab(predictions, bsm, 7, [70, 71])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("hashpartitioning(uid#") == 1 and "SortMergeJoin [uid#" not in plan


def test_packed_runs_lose_nothing(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "b", 4), (None, "b", 5), (2, None, 6), (1, "a", None)]
    table = spark.createDataFrame(rows, "uid long, wavekey string, x int").coalesce(1)
    got = [tuple(r) for r in packed_runs(table, ["uid", "wavekey"], "x").collect()]
    assert [(u, w, x) for u, w, xs in got for x in xs] == rows and len(got) < len(rows)
    assert packed_runs(table.where("uid = 9"), ["uid", "wavekey"], "x").count() == 0


def test_answers_are_grouped_after_they_are_dealt(spark):
    rows = [(1, "a", "m", 0, 2.5), (1, "a", "n", 1, 2.5), (1, "a", "m", 0, 2.5), (2, "a", "n", 1, 1.0), (1, "a", "n", 0, 2.5), (2, "b", "m", 0, 1.0), (3, "a", "n", 0, 1.0)]
    codes = spark.createDataFrame([("m", 0, 12), ("n", 1, 11), ("n", 0, 10)], "attribute string, attribute_value int, svkey int")
    audiences = spark.createDataFrame([(11, 12)], "svkey_1 int, svkey_2 int")
    people = spark.createDataFrame([(1, "a", 2.5), (2, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0)], "uid long, wavekey string, w double")
    people = people.select("uid", "wavekey", F.col("w").cast("decimal(18,2)").alias("respondentweight"))
    predictions = spark.createDataFrame(rows, "uid long, wavekey string, attribute_model string, selected_value int, w double")
    carried = predictions.withColumn("respondentweight", F.col("w").cast("decimal(18,2)")).drop("w")
    for table in (carried, predictions.drop("w")):
        held = held_answers(table, codes, people, audiences)
        assert sorted((r.wavekey, r.held, r.cents) for r in held.collect()) == [("a", [11], 100), ("a", [11, 12], 250), ("b", [12], 100)]
    plan = held_answers(carried, codes, people, audiences)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("hashpartitioning(uid#") :]
    assert "MapInArrow" in before_shuffle and "collect_" not in before_shuffle
