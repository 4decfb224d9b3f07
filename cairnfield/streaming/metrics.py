"""Structured Streaming forms of the incremental accumulators, and windows over events.

Each result is a small aggregate. It is kept as a Parquet table that every micro-batch replaces,
in the cluster's shared folder, next to the query's checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators.calibration import bin_of, scored
from cairnfield.operators.catalog import IGNORED


def stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of some files at a time.

    Zoned timestamps are needed for event time; those without a zone are read in the session's.
    """
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file, a plain path only a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(either)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/") + f"/stream-{uuid.uuid4().hex}"


def committed(batch: DataFrame, table: str, number: int, mode: str) -> None:
    """One micro-batch of a result, by its number: a batch that is run again replaces itself.

    A complete result is the whole table each time; the batches of an appended one are folders of their own.
    """
    batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/{number:012d}")


def results(spark: SparkSession, table: str, schema) -> DataFrame:
    """What all batches (or the last, complete one) left."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(table)


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming query over all that is there, and read what its last batch left (complete) or all batches (append)."""
    spark = result.sparkSession
    folder = shared_folder(spark)
    table = f"{folder}/table"
    spark.createDataFrame([], result.schema).write.parquet(table if mode == "complete" else f"{table}/start")  # a stream may have no batch
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda df, number: committed(df, table, number, mode)).start().awaitTermination()
    return results(spark, table, result.schema)


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of (event, target, pred) as they grow."""
    valid = rows.where((F.col("target") != IGNORED) & F.col("target").isNotNull())
    return valid.groupBy("event_id", "target", "pred").agg(F.count("*").alias("n"))


def calibration_bins(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Count, hits and summed confidence of each calibration bin as they grow."""
    s = scored(rows, temperature)
    hit = (F.col("pred") == F.col("target")).cast("long")
    return s.groupBy(bin_of(F.col("confidence")).alias("bin")).agg(F.count("*").alias("count"), F.sum(hit).alias("correct"), F.sum("confidence").alias("confidence"))


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and values by window and type; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap as long as ``gap``."""
    s = F.session_window("ts", gap).alias("s")
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def prediction(rows: DataFrame, logits: str = "logits") -> DataFrame:
    return rows.withColumn("pred", C.argmax(F.col(logits)))
