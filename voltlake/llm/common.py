"""Helpers shared by the operators: the cluster's shared folder, written intermediates, task counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def saved(frame: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read back: short lineage that outlives executors."""
    path = shared_dir(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions that a shuffle is dealt into in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(frame: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until no column of `frame` is called so."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
