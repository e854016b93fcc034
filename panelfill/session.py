"""Where a job may keep intermediate tables, and how tasks get the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelfill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the tasks of this application the package, once: their Python need not find it on a path of its own."""
    sc = spark.sparkContext
    if getattr(sc, "_panelfill_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="panelfill-"), "panelfill.zip")  # Spark copies it to its own file server
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._panelfill_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_parallel(tasks: Sequence[Callable], threads: int) -> list:
    """Run driver-side tasks that start Spark jobs; the jobs share the cluster."""
    if threads <= 1:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return [f.result() for f in [pool.submit(inherit(task)) for task in tasks]]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For small results that later meet large tables: Spark knows the size of files, and
    broadcasts them when they are below its threshold and only then.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
