"""Totals next to rows: one-row frames as scalar subqueries, so no join is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Add each column of a one-row frame to every row.

    The totals are one subquery that returns a struct, so they are computed once.
    """
    one = totals.select(F.struct(*totals.columns).alias("s")).scalar()
    with_one = rows.withColumn("__totals", one)
    return with_one.select(*rows.columns, *[F.col(f"__totals.{c}").alias(c) for c in totals.columns])
