"""Joins and small aggregates behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def protocol(run: Column) -> Column:
    """Event-held-out or standard, by the name of a run."""
    return F.when(F.lower(run).rlike("holdout|heldout"), "event_held_out").otherwise("standard")


def modality(mode: Column) -> Column:
    return F.when(mode.isin("sar_only", "optical_only"), F.regexp_replace(mode, "_only", "")).when(mode.isNull(), "unknown").otherwise("multimodal")


def heldout_vs_standard(heldout: DataFrame, standard: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Held-out rows with their standard counterpart's metrics and the gap (standard - held out)."""
    other = standard.select(*keys, *[F.col(m).alias(f"standard_{m}") for m in metrics])
    rows = heldout.select(*keys, *[F.col(m).alias(f"heldout_{m}") for m in metrics]).join(other, keys, "left")
    return rows.withColumns({f"gap_{m}": F.col(f"standard_{m}") - F.col(f"heldout_{m}") for m in metrics})


def first_counterpart(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several standard runs of one key the first."""
    return runs.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def missing_modes(found: DataFrame, required: list[str], column: str = "fusion_mode") -> DataFrame:
    wanted = found.sparkSession.createDataFrame([(r,) for r in required], f"{column} string")
    return wanted.join(found.select(column), column, "left_anti")


def metric(payload: Column, name: str) -> Column:
    """A metric of a JSON text: at the top, or else under ``pooled``."""
    return F.coalesce(F.get_json_object(payload, f"$.{name}"), F.get_json_object(payload, f"$.pooled.{name}")).cast("double")


def interval(lower: Column, upper: Column) -> Column:
    text = F.format_string("[%.3f, %.3f]", lower, upper)
    return F.when(lower.isNull() | upper.isNull(), "not available").otherwise(text)


def per_event_rows(payload: DataFrame, column: str = "json") -> DataFrame:
    """Rows of the per_event list of metrics files, with protocol and model (unknown where absent)."""
    schema = "protocol string, model string, per_event array<struct<event_id: string, miou: double, f1_damage: double>>"
    rows = payload.select(F.from_json(F.col(column), schema).alias("m"))
    return rows.select(F.coalesce("m.protocol", F.lit("unknown")).alias("protocol"), F.coalesce("m.model", F.lit("unknown")).alias("model"), F.explode("m.per_event").alias("e")).select("protocol", "model", "e.*")


def best_epoch(history: DataFrame, by: list[str], metric_: str = "val_f1_damage") -> DataFrame:
    """The epoch with the greatest metric, the first of equals."""
    return history.groupBy(*by).agg(F.max_by("epoch", F.struct(F.col(metric_), -F.col("epoch"))).alias("epoch"), F.max(metric_).alias(metric_))


def records_so_far(history: DataFrame, by: list[str], metric_: str) -> DataFrame:
    """Flag epochs that beat all earlier ones."""
    before = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("is_best", F.col(metric_) > F.coalesce(F.max(metric_).over(before), F.lit(float("-inf"))))


def markdown_table(rows: DataFrame, columns: list[str], order: str, most: int = 200) -> str:
    """A report table of a small aggregate; ``most`` bounds what comes to the driver."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in rows.select(*columns).orderBy(order).limit(most).collect():
        lines.append("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)
