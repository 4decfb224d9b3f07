"""Arrays that meet by position: chunks of logits and of masks, joined before any pixel is a row.

A chunk is (tile_id, block) with arrays in row order; logits go class by class. What needs pixels
one by one gets them behind the join, and what only needs counts never does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.operators.catalog import IGNORED
from cairnfield.sources.files import ship

KEYS = ["tile_id", "block"]


def aligned(logits: DataFrame, masks: DataFrame, classes: int) -> DataFrame:
    """Columns of ``logits`` (tile_id, block, logits, ...) with ``mask`` of the same tile and block.

    A chunk without its counterpart, and arrays that differ in pixels, are errors.
    """
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in KEYS])
    both = logits.join(masks.select(*KEYS, "mask"), KEYS, "full_outer")
    fit = F.size("logits") == classes * F.size("mask")
    fault = F.when(F.col("logits").isNull() | F.col("mask").isNull(), F.concat(F.lit("No counterpart of chunk "), key)).when(~fit, F.concat(F.lit("Logits and mask differ in shape in chunk "), key))
    return both.withColumn("mask", F.when(fault.isNotNull(), F.raise_error(fault).cast("array<int>")).otherwise(F.col("mask")))


def confusion(logits: DataFrame, masks: DataFrame, classes: int = 4) -> DataFrame:
    """Counts of (event_id, target, pred), zeros included, and pooled ones under a null event.

    The greatest logit decides, the first of equal ones; ignored pixels don't count, and a label
    that is no class is an error. Each chunk is counted where its arrays meet.
    """
    ship(logits.sparkSession)

    @F.arrow_udf("array<bigint>")
    def counted(z: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for scores, labels in zip(z, m, strict=True):
            target = labels.values.to_numpy(zero_copy_only=False)
            pred = scores.values.to_numpy(zero_copy_only=False).reshape(classes, -1).argmax(axis=0)
            valid = target != IGNORED
            target = target[valid].astype(np.int64)
            if len(target) and not 0 <= target.min() <= target.max() < classes:
                raise ValueError("A mask has labels that are no class")
            out.append(np.bincount(target * classes + pred[valid], minlength=classes * classes))
        return pa.array(out, pa.list_(pa.int64()))

    chunks = aligned(logits, masks, classes).select("event_id", counted("logits", "mask").alias("n"))
    cells = chunks.select("event_id", F.posexplode("n").alias("k", "n")).groupBy("event_id", "k").agg(F.sum("n").alias("n"))
    pooled = cells.groupBy("k").agg(F.sum("n").alias("n")).select(F.lit(None).cast(cells.schema["event_id"].dataType).alias("event_id"), "k", "n")
    return cells.union(pooled).select("event_id", F.floor(F.col("k") / classes).cast("int").alias("target"), (F.col("k") % classes).cast("int").alias("pred"), "n")


def pixels(chunks: DataFrame, classes: int = 4) -> DataFrame:
    """(tile_id, event_id, row, col, logits, target) of each pixel of aligned chunks (with row and width)."""
    n = F.size("mask")
    bands = [F.slice("logits", n * c + 1, n).alias(f"z{c}") for c in range(classes)]
    zipped = F.arrays_zip(F.col("mask").alias("target"), *bands)
    rows = chunks.select("tile_id", "event_id", "width", F.col("row").alias("top"), F.posexplode(zipped).alias("k", "p"))
    return rows.select("tile_id", "event_id", (F.col("top") + F.floor(F.col("k") / F.col("width"))).cast("int").alias("row"), (F.col("k") % F.col("width")).cast("int").alias("col"), F.array(*[F.col(f"p.z{c}").cast("double") for c in range(classes)]).alias("logits"), F.col("p.target").alias("target"))
