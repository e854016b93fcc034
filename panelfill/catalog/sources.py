"""Queries for readers and writers: each writes survey tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfill import schemas
from panelfill.catalog.base import predictions_of, query
from panelfill.operators.shares import wave_totals
from panelfill.session import new_folder
from panelfill.sources import tables


@query("a1_read_table", "SELECT o_orderkey AS uid, o_orderstatus AS status, o_totalprice AS weight FROM orders")
def a1(s):
    return tables.read_table(s.spark, f"{s.folder}/orders.parquet").select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("weight")
    )


@query(
    "a2_read_results_csv",
    "SELECT uid, set_uid, wavekey, attribute_model, label, max_prediction, selected_value FROM predictions",
)
def a2(s):
    path = new_folder(s.spark, "predictions-csv")
    predictions_of(s).write.option("header", True).csv(path)
    return tables.read_results_csv(s.spark, path, schemas.PREDICTIONS)


@query(
    "a3_list_model_outputs",
    "SELECT DISTINCT attribute_model AS model, attribute_model || '_predictions' AS output FROM predictions",
)
def a3(s):
    root = new_folder(s.spark, "model-outputs")
    tables.write_model_csv(predictions_of(s), root, "predictions")
    found = tables.list_model_outputs(s.spark, root, "predictions")
    return found.select("model", F.regexp_extract("path", r"([^/=]+)$", 1).alias("output"))


@query(
    "a4_with_model_from_path",
    """SELECT attribute_model, set_uid, count(*) AS n, CAST(sum(selected_value) AS BIGINT) AS total
       FROM predictions GROUP BY attribute_model, set_uid""",
)
def a4(s):
    root = new_folder(s.spark, "model-outputs")
    tables.write_model_csv(predictions_of(s), root, "predictions")
    rows = tables.read_results_csv(s.spark, f"{root}/*/*predictions", schemas.PREDICTIONS).drop("attribute_model")
    return (
        tables.with_model_from_path(rows)
        .groupBy("attribute_model", "set_uid")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("selected_value").alias("total"))
    )


@query("a5_read_attribute", "SELECT uid, wavekey, set_uid, label FROM matrix WHERE attribute = '102'")
def a5(s):
    path = new_folder(s.spark, "attribute-matrix")
    tables.write_partitioned(s.matrix, path, "attribute", copy_as="attribute2")
    return tables.read_attribute(s.spark, path, "102").select("uid", "wavekey", "set_uid", "label")


@query("a6_read_split_folders", "SELECT uid, set_uid AS split, ld_0, ld_1 FROM latent")
def a6(s):
    root = new_folder(s.spark, "latent")
    splits = ["train", "test", "validation"]
    for name in splits:
        s.latent.where(F.col("set_uid") == name).select("uid", "ld_0", "ld_1").write.option("header", True).csv(f"{root}/{name}")
    schema = T.StructType(
        [T.StructField("uid", T.LongType()), T.StructField("ld_0", T.DoubleType()), T.StructField("ld_1", T.DoubleType())]
    )
    return tables.read_split_folders(s.spark, root, splits, schema).select("uid", "split", "ld_0", "ld_1")


# fixed values: column of each attribute in the sparse rows
COLUMN_OF = {"101": 1, "102": 2, "103_1031": 3, "104_1041": 4, "104_1042": 5, "104_1043": 6}
COLUMN_SQL = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in COLUMN_OF.items()) + " END"


def sparse_rows(s):
    """One sparse text row per respondent: 0 (absent) is missing, k is answer code k."""
    column = F.lit(None).cast("int")
    for name, i in COLUMN_OF.items():
        column = F.when(F.col("attribute") == name, i).otherwise(column)
    entry = F.concat(column, F.lit(":"), (F.col("label") + 1).cast("int"))
    return s.labels.groupBy("uid", "wavekey", "set_uid").agg(
        F.concat_ws(" ", F.lit("0"), F.concat_ws(" ", F.array_sort(F.collect_list(entry)))).alias("libsvm")
    )


@query(
    "a7_libsvm_to_long",
    f"SELECT uid, wavekey, {COLUMN_SQL} - 1 AS idx, CAST(label + 1 AS DOUBLE) AS value FROM coded_labels",
)
def a7(s):
    return tables.libsvm_to_long(sparse_rows(s), width=6).select("uid", "wavekey", "idx", "value")


@query(
    "a9_write_table",
    "SELECT svkey, wavekey, count(*) AS n, sum(label) AS chosen FROM bsm GROUP BY svkey, wavekey",
)
def a9(s):
    path = new_folder(s.spark, "answers")
    tables.write_table(s.bsm, path)
    return tables.read_table(s.spark, path).groupBy("svkey", "wavekey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("chosen")
    )


@query(
    "a10_write_partitioned",
    """SELECT attribute, attribute AS attribute2, set_uid, count(*) AS n, sum(label) AS total
       FROM matrix GROUP BY attribute, set_uid""",
)
def a10(s):
    path = new_folder(s.spark, "attribute-matrix")
    tables.write_partitioned(s.matrix, path, "attribute", copy_as="attribute2", sort_by=["sakey", "svkey", "uid"])
    back = s.spark.read.option("basePath", path).parquet(path)
    return (
        back.groupBy("attribute", F.col("attribute2").cast("string").alias("attribute2"), "set_uid")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("total"))
    )


@query("a11_write_report_csv", "SELECT wavekey, round(wave_total_weight, 2) AS wave_total_weight FROM totals")
def a11(s):
    path = new_folder(s.spark, "report")
    tables.write_report_csv(wave_totals(s.respondents), path, single_file=True)
    schema = "wavekey string, wave_total_weight double"
    return s.spark.read.schema(schema).option("header", True).csv(path).select("wavekey", F.round("wave_total_weight", 2).alias("wave_total_weight"))


@query("a12_materialize_once", "SELECT wavekey, round(wave_total_weight, 2) AS wave_total_weight FROM totals")
def a12(s):
    path = new_folder(s.spark, "once")

    def refuse():
        raise AssertionError("built twice")

    tables.materialize_once(s.spark, path, lambda: wave_totals(s.respondents))
    return tables.materialize_once(s.spark, path, refuse).select("wavekey", F.round("wave_total_weight", 2).alias("wave_total_weight"))
