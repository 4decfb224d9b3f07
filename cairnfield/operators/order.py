"""Exact quantiles and ranks of any number of rows, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.operators.iterate import kept
from cairnfield.operators.scalars import with_scalars

#: A sketch of this accuracy places a value within 1 / ACCURACY of its rank; brackets are three times as wide.
ACCURACY = 10_000
MARGIN = 3 / ACCURACY
#: Of fewer values a bracket may be narrower than the step between two ranks; all of them are counted.
FEW = 2 * ACCURACY


def quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]], by: list[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, as ``percentile`` has them: one row (of each group of ``by``).

    ``wanted`` names each result, its column and its share. A sketch brackets every quantile; all
    values below and above a bracket are counted as one, so that equal values and the few different
    ones inside it are all that is sorted. Nulls don't count; no values give null. The rows are
    read twice: checkpoint them first where they are costly.
    """
    by = list(by)
    names = list(wanted)
    value = {n: f"__v{i}" for i, n in enumerate(names)}
    base = rows.select(*by, *[c.cast("double").alias(value[n]) for n, (c, _) in wanted.items()])
    ends = {n: F.array(F.lit(max(0.0, q - MARGIN)), F.lit(min(1.0, q + MARGIN))) for n, (_, q) in wanted.items()}
    near = [F.percentile_approx(value[n], ends[n], ACCURACY).alias(f"__b{i}") for i, n in enumerate(names)]
    near += [F.count(value[n]).alias(f"__n{i}") for i, n in enumerate(names)]
    bracketed = base.join(base.groupBy(*by).agg(*near), by) if by else with_scalars(base, base.agg(*near))

    def label(i: int, n: str) -> Column:
        v, b = F.col(value[n]), F.col(f"__b{i}")
        inside = F.when(F.col(f"__n{i}") < FEW, v).when(v < b[0], F.lit(float("-inf"))).when(v > b[1], F.lit(float("inf"))).otherwise(v)
        return F.struct(F.lit(i).alias("i"), F.lit(float(wanted[n][1])).alias("q"), inside.alias("v"))

    labels = bracketed.select(*by, F.explode(F.array(*[label(i, n) for i, n in enumerate(names)])).alias("__l")).select(*by, "__l.*")
    counts = labels.where("v IS NOT NULL").groupBy(*by, "i", "q", "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by, "i")
    upto = F.sum("n").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = (F.sum("n").over(group) - 1) * F.col("q")
    placed = counts.select(*by, "i", "v", upto.alias("upto"), place.alias("place"))
    low, high = F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v")))
    found = placed.groupBy(*by, "i").agg(F.first("place").alias("p"), low.alias("low"), high.alias("high"))
    between = (F.ceil("p") - F.col("p")) * F.col("low") + (F.col("p") - F.floor("p")) * F.col("high")
    found = found.withColumn("at", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("at"))).alias(n) for i, n in enumerate(names)])


def numbered(rows: DataFrame, order: list[Column], out: str, by: list[str] = ()) -> DataFrame:
    """Number the rows (of each group of ``by``) from 1 in ``order``, which must not leave ties.

    The rows are dealt by ranges of the whole order, so neither a large group nor many equal first
    keys meet in one task; each range is numbered on its own and shifted by the ranges before it.
    The ranges are checkpointed, as both uses of them must agree.
    """
    ranges = rows.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__range", F.spark_partition_id())
    ranges = kept(ranges)
    sizes = ranges.groupBy(*by, "__range").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    shifted = ranges.withColumn("__n", within).join(shifts, [*by, "__range"])
    return shifted.withColumn(out, (F.col("__n") + F.col("__before")).cast("long")).drop("__range", "__n", "__before")
