"""Cutting lineage in a way that survives losing executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master, as in the tests, may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="spark-pinned-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and return a read of it.

    The plan ends there, the rows are columnar, and the table's size is known to the joins
    that follow.
    """
    path = f"{shared_folder(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
