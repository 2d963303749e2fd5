"""Steps of loops as tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where all tasks run on this machine and the session names no shared folder (tests).
LOCAL = "/tmp/reportloom-steps"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster must name."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return LOCAL
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as a shuffle has, all cores at least: for rows that cost much more
    than moving them, as a small file with many rows is read in few splits and keeps few cores busy."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def step(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, whatever reads it and whichever executor is lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/reportloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
