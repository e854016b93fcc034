"""Schemas of the stored tables. Long tables are the stored form; wide ones exist only as output."""

from __future__ import annotations

from pyspark.sql import types as T

TAXONOMY = T.StructType(
    [
        T.StructField("sakey", T.IntegerType()),
        T.StructField("svkey", T.IntegerType()),
        T.StructField("multi", T.BooleanType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("alternate_svkey_binary_single", T.IntegerType()),
        T.StructField("value", T.IntegerType()),
        T.StructField("final_index", T.IntegerType()),
        T.StructField("proposed_round", T.IntegerType()),
        T.StructField("is_display_logic_sakey", T.BooleanType()),
        T.StructField("is_display_logic_svkey", T.BooleanType()),
        T.StructField("min_level", T.IntegerType()),
        T.StructField("needs_imputation", T.BooleanType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("set_uid", T.StringType()),
        T.StructField("wavekey", T.StringType()),
        T.StructField("attribute_model", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("max_prediction", T.IntegerType()),
        T.StructField("selected_value", T.IntegerType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("num_class", T.IntegerType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("finish_time", T.DoubleType()),
        T.StructField("total_time", T.DoubleType()),
        T.StructField("retried", T.BooleanType()),
    ]
)
