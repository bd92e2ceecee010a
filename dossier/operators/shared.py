"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; on a single machine without it, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many tasks as the session's shuffles have: a small file, read by one, may hold a lot of work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to as many tasks as the session's shuffles have, whatever their size.

    For steps that sort many short rows: by their compressed size alone, Spark
    would put so many into one task that it sorts gigabytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
