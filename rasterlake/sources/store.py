"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlake.sources import images

ROWS = 250_000  # that dealt() gives a task


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of its own in the work folder and reads it back: what several branches of a plan read is made once, and lineage
    ends at files that outlive executors."""
    path = f"{images.work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """df by keys, in so many times the session's number of partitions that a task has ROWS rows or fewer on average. So what a task
    sorts or groups doesn't grow with the table, and later steps on these keys need no other shuffle. df: a table that is read from files, at
    most with other columns (then its rows are counted by the files' footers). like: a larger table that is dealt alike, to be joined with."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = -(-(df if like is None else like).count() // (ROWS * usual))
    return df.repartition(times * usual, *keys) if times > 1 else df


def drop_work(spark: SparkSession) -> None:
    """Deletes the work folders of this application; call it once results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(images.work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
