"""Reading and writing tables, result folders and the ledger of finished models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelfill.functions.survey import model_of
from panelfill.session import in_parallel


# ---- reading ---------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_results_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | None = None) -> DataFrame:
    """CSV with header. Without a schema Spark infers one, which costs another pass over the files."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def list_model_outputs(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Files below ``<root>/<model>/<model>_<kind>`` as (model, path); contents are not read."""
    suffix = f"_{kind}"
    path = F.regexp_replace(F.col("path"), r"/part-[^/]*$", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(path.alias("path"))
    output = _folder_value(F.split_part("path", F.lit("/"), F.lit(-1)))
    return (
        files.where(F.col("path").endswith(suffix))
        .distinct()
        .select(F.split_part(output, F.lit(suffix), F.lit(1)).alias("model"), "path")
    )


def _folder_value(name):
    """Folder name without the ``column=`` of a partitioned table."""
    return F.regexp_replace(name, r"^[^=]*=", "")


def with_model_from_path(df: DataFrame, column: str = "attribute_model") -> DataFrame:
    """Adds the model name taken from the folder ``<model>_predictions`` each row was read from."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")
    return df.withColumn(column, _folder_value(model_of(folder)))


def read_attribute(spark: SparkSession, root: str, attribute: str) -> DataFrame:
    """One attribute of the partitioned label matrix; only its folder is scanned."""
    return spark.read.parquet(root).where(F.col("attribute2") == attribute)


def read_split_folders(
    spark: SparkSession, root: str, splits: Iterable[str], schema: StructType | None = None
) -> DataFrame:
    """Union of the CSV folders ``<root>/<split>``, with the split name of each row."""
    df = read_results_csv(spark, [f"{root}/{s}" for s in splits], schema)
    return df.withColumn(
        "split", _folder_value(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    )


def libsvm_to_long(df: DataFrame, text: str = "libsvm", width: int | None = None) -> DataFrame:
    """Sparse rows ``[label] i:v i:v ...`` (1-based indices) to one row per entry.

    A token without ``:`` is the leading label and is skipped, as are indices beyond ``width``.
    """
    entries = df.withColumn("entry", F.explode(F.split(F.trim(F.col(text)), r"\s+"))).where(F.contains("entry", F.lit(":")))
    long = entries.select(
        *[c for c in df.columns if c != text],
        (F.split_part("entry", F.lit(":"), F.lit(1)).try_cast("int") - 1).alias("idx"),
        F.split_part("entry", F.lit(":"), F.lit(2)).try_cast("double").alias("value"),
    )
    return long if width is None else long.where(F.col("idx").between(0, width - 1))


def jdbc_query_options(
    url: str, sql: str, props: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None
) -> dict[str, str]:
    """Reader options that leave ``sql`` to the database.

    ``partition`` is (column, lower, upper, partitions): the database then answers that many
    range queries instead of streaming everything to one task.
    """
    options = {"url": url, **(props or {})}
    if partition is None:
        return {**options, "query": sql}
    column, lower, upper, parts = partition
    return {
        **options,
        "dbtable": f"({sql}) q",
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
    }


def read_jdbc_query(spark: SparkSession, url: str, sql: str, props=None, partition=None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_query_options(url, sql, props, partition)).load()


# ---- writing ---------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Without a compression Spark takes the session's."""
    writer = df.write.mode("overwrite")
    (writer if compression is None else writer.option("compression", compression)).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str, copy_as: str | None = None, sort_by: Sequence[str] = ()) -> None:
    """One folder per value of ``by``; ``copy_as`` names a copy to partition on, so ``by`` stays in the files.

    Rows of a value are gathered by a rebalance, which adaptive execution splits when one value
    is far larger than the others.
    """
    folder = copy_as or by
    out = df.withColumn(folder, F.col(by)) if copy_as else df
    out = out.hint("rebalance", F.col(folder))
    if sort_by:
        out = out.sortWithinPartitions(folder, *sort_by)
    out.write.mode("overwrite").partitionBy(folder).parquet(path)


def write_report_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; ``single_file`` is for reports that one task can write."""
    (df.repartition(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_model_csv(df: DataFrame, root: str, kind: str, model: str = "attribute_model") -> None:
    """Results as ``<root>/<model>/<model>_<kind>`` CSV folders, all models in one job."""
    out = df.withColumn("model_dir", F.col(model)).withColumn("kind_dir", F.concat(F.col(model), F.lit(f"_{kind}")))
    out.hint("rebalance", "kind_dir").write.mode("overwrite").option("header", True).partitionBy(
        "model_dir", "kind_dir"
    ).csv(root)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and store a table unless a finished one is there, then read it back.

    Such tables are written once and read often, and repeat their codes: zstd makes about half of what Spark's default makes of them.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_table(build(), path, "zstd")
    return read_table(spark, path)


def append_ledger(times: DataFrame, path: str) -> None:
    times.write.mode("append").parquet(path)


def commit_record(record: DataFrame, root: str) -> None:
    """One record in a folder of its own, so that writers side by side do not meet; it is there as a whole or not at all."""
    record.coalesce(1).write.parquet(f"{root}/{uuid.uuid4().hex}")


def pending_models(expected: DataFrame, ledger: DataFrame, redo: bool = False) -> DataFrame:
    """Expected models (column ``model``) that have no completion record yet."""
    return expected if redo else expected.join(ledger.select("model"), "model", "left_anti")


def write_result_bundle(root: str, frames: Mapping[str, DataFrame], partition: str = "attribute_model") -> None:
    """Each result kind as one table partitioned by model; a rerun replaces only its own models.

    The kinds do not depend on each other, so their jobs run side by side.
    """

    def write(kind: str, df: DataFrame) -> None:
        (
            df.hint("rebalance", partition)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(f"{root}/{kind}")
        )

    in_parallel([lambda kind=kind, df=df: write(kind, df) for kind, df in frames.items()], len(frames))
