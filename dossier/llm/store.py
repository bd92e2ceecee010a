"""Tables written to the folder that all machines share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one where it is unset on a single machine, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, tag: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    With ``tasks``, at most so many write it; more than the session's shuffle
    partitions are never asked for.

    Later stages, and tasks run again after an executor is lost, read the same
    rows from there: nothing is computed twice and nothing lives on one machine.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if tasks and tasks < input_partitions(df):
        df.coalesce(tasks).write.parquet(path)
    else:
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def forget(*frames: DataFrame | None) -> None:
    """Remove what ``written`` wrote. Only for tables from which all that follows has been written in turn."""
    for df in frames:
        if df is None:
            continue
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def input_partitions(df: DataFrame, least: int = 0) -> int:
    """Shuffle partitions of the session, never under ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
