"""What the iterative operators share: tables between rounds, and the test for a fixed point."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.sources import files


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one below the warehouse where that is unset, as in tests."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the cluster's shared folder.

    It cuts the lineage of a loop and survives lost executors, and unlike a checkpoint it has the size
    of its own files: a checkpoint inherits an estimate that each join of a loop multiplies.
    """
    spark = df.sparkSession
    path = f"{shared_base(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def released(df: DataFrame) -> None:
    """Delete what ``kept`` wrote, once nothing reads it any more; frames of other origin stay."""
    path = getattr(df, "_kept_path", None)
    if path is None:
        return
    try:
        system, inner = files.store(path)
    except (OSError, ValueError, ImportError):  # a store that only Spark reaches: the folder's owner clears it
        return
    system.delete_dir(inner)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows for a join whose sides are both dealt by key: a side that grows with the input is not sent whole
    through the driver to every executor, however small its files are."""
    return df.hint("merge")


def same(before: DataFrame, after: DataFrame, value: str) -> bool:
    """Whether values that only fall have stopped falling: their sums agree."""
    total = F.sum(F.col(value).cast("decimal(38,6)"))
    return before.agg(total).first()[0] == after.agg(total).first()[0]
