"""What the stored tables of the survey move: a respondent's rows are dealt once, and not again by the tables made of them."""

import os

import pytest
from pyspark.sql import functions as F

from panelfill.sources.survey import MODELS, Survey

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_people_are_stored_once_and_scores_deal_nobody_again(spark):
    survey = Survey(spark, FOLDER)
    assert "hashpartitioning(uid#" not in plan_of(survey._scores())
    people = survey.people
    assert people.count() == survey.respondents.count() == people.select("uid").distinct().count()
    held = people.select("uid", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"l{a}").alias("label")) for a in MODELS])).alias("e"))
    labels = survey.labels.where(F.col("attribute").isin(*MODELS)).groupBy("uid", "attribute").agg(F.max("label").alias("label"))
    got = {(r.uid, r.attribute, r.label) for r in held.select("uid", "e.*").where("label IS NOT NULL").collect()}
    assert got == {(r.uid, r.attribute, r.label) for r in labels.where("label IS NOT NULL").collect()}


def test_lines_are_not_moved_to_the_customers(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(Survey(spark, FOLDER).orders)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.index("hashpartitioning(uid#") < plan.index("hashpartitioning(o_custkey#")  # written from its end


def test_stored_tables_are_compressed_well(spark):
    files = Survey(spark, FOLDER).scores.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
