import pytest
from pyspark.sql import functions as F

from panelfill import schemas, session
from panelfill.plans import rounds as pr
from panelfill.sources import tables


def test_libsvm_rows(spark):
    rows = [(1, "0 1:2 3:1"), (2, ""), (3, "6:5"), (4, "1 2:1 9:4"), (5, None)]
    df = spark.createDataFrame(rows, "uid int, libsvm string")
    got = sorted((r.uid, r.idx, r.value) for r in tables.libsvm_to_long(df, width=6).collect())
    assert got == [(1, 0, 2.0), (1, 2, 1.0), (3, 5, 5.0), (4, 1, 1.0)]


def test_pending_models(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    path = session.new_folder(spark, "ledger")

    def done(*models):
        return spark.createDataFrame([(m, 2, 0, 0.0, 1.0, 1.0, False) for m in models], schemas.LEDGER)

    assert {r.model for r in tables.pending_models(expected, done()).collect()} == {"a", "b", "c"}
    tables.append_ledger(done("b"), path)
    tables.append_ledger(done("a"), path)
    ledger = spark.read.schema(schemas.LEDGER).parquet(path)
    assert {r.model for r in tables.pending_models(expected, ledger).collect()} == {"c"}
    assert tables.pending_models(expected, done("a", "b", "c")).count() == 0
    assert tables.pending_models(expected, ledger, redo=True).count() == 3


def test_materialize_once(spark):
    path = session.new_folder(spark, "once")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert tables.materialize_once(spark, path, build).count() == 3
    assert tables.materialize_once(spark, path, build).count() == 3
    assert len(calls) == 1


def test_bundle_replaces_only_its_models(spark):
    root = session.new_folder(spark, "bundle")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "attribute_model string, v int")
    tables.write_result_bundle(root, {"k": df})
    tables.write_result_bundle(root, {"k": df.where("attribute_model = 'a'").withColumn("v", F.lit(9))})
    assert sorted((r.attribute_model, r.v) for r in pr.read_kind(spark, root, "k").collect()) == [("a", 9), ("b", 2)]


def test_partitioned_write_keeps_the_column_and_prunes(spark):
    path = session.new_folder(spark, "matrix")
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("attribute"))
    tables.write_partitioned(df, path, "attribute", copy_as="attribute2", sort_by=["id"])
    one = tables.read_attribute(spark, path, "1")
    assert one.count() == 333 and one.select("attribute").distinct().count() == 1
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(attribute2" in scan


def test_results_csv_and_model_outputs(spark):
    root = session.new_folder(spark, "csv")
    df = spark.createDataFrame([(1, "train", "w", "5_1", 1, 1, 1), (2, "test", "w", "6", None, 0, 0)], schemas.PREDICTIONS)
    tables.write_model_csv(df, root, "predictions")
    listed = {r.model for r in tables.list_model_outputs(spark, root, "predictions").collect()}
    assert listed == {"5_1", "6"} and tables.list_model_outputs(spark, root, "metrics").count() == 0
    back = tables.read_results_csv(spark, f"{root}/*/*predictions", schemas.PREDICTIONS).drop("attribute_model")
    named = tables.with_model_from_path(back)
    assert {(r.uid, r.attribute_model, r.label) for r in named.collect()} == {(1, "5_1", 1), (2, "6", None)}


def test_report_csv_is_one_file_on_request(spark):
    small, large = session.new_folder(spark, "r"), session.new_folder(spark, "r")
    df = spark.range(100).repartition(4)
    tables.write_report_csv(df, small, single_file=True)
    tables.write_report_csv(df, large)

    def files(p):
        return spark.read.format("binaryFile").load(f"{p}/*.csv").count()

    assert files(small) == 1 and files(large) > 1
    assert spark.read.option("header", True).csv(large).count() == 100


def test_jdbc_options():
    plain = tables.jdbc_query_options("jdbc:x", "select 1", {"driver": "d"})
    assert plain == {"url": "jdbc:x", "driver": "d", "query": "select 1"}
    split = tables.jdbc_query_options("jdbc:x", "select k from t", partition=("k", 0, 100, 8))
    assert split["dbtable"] == "(select k from t) q" and split["numPartitions"] == "8" and "query" not in split


def test_shared_dir_is_the_named_one(spark):
    assert session.new_folder(spark, "x").startswith(session.shared_dir(spark))
    old = spark.conf.get("spark.checkpoint.dir", None)
    if old is None:
        try:
            spark.conf.set("spark.checkpoint.dir", "/some/shared/place")
            assert session.shared_dir(spark) == "/some/shared/place"
        finally:
            spark.conf.unset("spark.checkpoint.dir")


def test_expected_and_missing_models(spark):
    plan = spark.createDataFrame(
        [("a", 1, 0, True), ("a", 2, 0, False), ("b", 3, 0, True), ("c", 4, 1, True), ("d", 5, 0, False)],
        "attribute string, svkey int, proposed_round int, needs_imputation boolean",
    )
    expected = pr.expected_models(plan)
    assert {r.model for r in expected.collect()} == {"b"}
    ledger = spark.createDataFrame([("b", 2, 0, 0.0, 1.0, 1.0, False)], schemas.LEDGER)
    assert pr.missing_models(expected, ledger, plan).count() == 0
    assert [r.svkey for r in pr.missing_models(expected, ledger.where("false"), plan).collect()] == [3]


@pytest.mark.parametrize("rows", [5, 500])
def test_round0_inputs(spark, rows):
    responses = spark.range(rows).select(F.col("id").alias("uid"), F.lit("w").alias("wavekey"), F.lit("0 1:3 2:1").alias("libsvm"))
    latent = spark.range(rows - 1).select(F.col("id").alias("uid"), F.lit("train").alias("set_uid"))
    assert pr.round0_inputs(responses, latent, 2).count() == 2 * (rows - 1)


def test_reports_join_no_respondents_row_by_row(spark):
    """Scores carry the weight and are made of one row a respondent: neither joins models or reports by respondent and model."""
    from panelfill.catalog.base import answers_of, predictions_of
    from panelfill.operators.shares import with_weights
    from panelfill.sources.survey import Survey

    s = Survey(spark, "/root/testdata/sf0.001")
    plan = s._scores()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("uid#" in line and "attribute_model#" in line for line in joins)
    joined = with_weights(predictions_of(s), s.respondents)
    assert with_weights(answers_of(s), s.respondents).exceptAll(joined.select(answers_of(s).columns)).isEmpty()
    assert "Join" not in with_weights(answers_of(s), s.respondents)._jdf.queryExecution().optimizedPlan().toString()
