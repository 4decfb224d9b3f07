"""Parquet tables, dealt out where their files are too few for the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Smaller tables are left as they are, and so are tables of larger files, which split.
WORTH_BYTES, SPLIT_BYTES = 2 << 20, 256 << 20


def widened(df: DataFrame) -> DataFrame:
    """The same rows over all cores, if a table has a few small files for less than half of them.

    Such files are one row group each, and would keep a costly expression on few cores. Large
    tables come in more files than there are cores, or in files that split; nothing is moved then.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = len(df._jdf.inputFiles())  # a number; the names stay in the JVM
    cores = df.sparkSession.sparkContext.defaultParallelism
    narrow = size >= WORTH_BYTES and size < files * SPLIT_BYTES and 2 * files <= cores
    return df.repartition(cores) if narrow else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
