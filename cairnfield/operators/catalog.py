"""The tile catalogue: alignment of modalities, label and intensity audits, event summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators.scalars import with_scalars

#: The label schema of the damage masks.
CLASSES = {0: "background", 1: "intact", 2: "damaged", 3: "destroyed"}
IGNORED = 255


def duplicate_ids(tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """Ids that are listed more than once, with their count."""
    return tiles.groupBy(key).count().where("count > 1")


def align(modalities: dict[str, DataFrame], key: str = "tile_id") -> DataFrame:
    """Which modalities hold each id: one boolean column for each, and ``aligned``.

    One pass over the union of all ids; no join, so nothing is lost on either side.
    """
    tagged = reduce(DataFrame.union, [df.select(F.col(key), F.lit(name).alias("__m")) for name, df in modalities.items()])
    present = [F.coalesce(F.max(F.when(F.col("__m") == name, True)), F.lit(False)).alias(name) for name in modalities]
    found = tagged.groupBy(key).agg(*present)
    return found.withColumn("aligned", reduce(Column.__and__, [F.col(name) for name in modalities]))


def misaligned(modalities: dict[str, DataFrame], key: str = "tile_id") -> DataFrame:
    """Ids that some modality lacks (the symmetric difference), and the modalities that lack them."""
    lacking = F.concat_ws(",", *[F.when(~F.col(name), F.lit(name)) for name in modalities])
    return align(modalities, key).where("NOT aligned").select(key, lacking.alias("missing"))


def require_none(violations: DataFrame, message: str) -> None:
    """Fail with a preview of at most five violating rows."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def parse_tile_ids(tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """Add event, disaster and number, as they stand in the id; ``valid`` is false where they don't."""
    event = C.tile_event(F.col(key))
    return tiles.withColumns({"event": event, "disaster": C.disaster_type(event), "number": C.tile_ordinal(F.col(key)), "valid": event.isNotNull()})


def label_violations(labels: DataFrame, column: str, allowed: set[int], ignored: set[int] = frozenset({IGNORED})) -> DataFrame:
    """Label values outside of the schema, with the number of rows that hold them."""
    return labels.where(~F.col(column).isin(*sorted(allowed | set(ignored)))).groupBy(column).agg(F.count("*").alias("n_rows"))


def class_names(labels: DataFrame, column: str, names: dict[int, str] | None = None) -> DataFrame:
    """Add class_name, null for ids without a name."""
    names = names or CLASSES
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return labels.withColumn("class_name", table[F.col(column).cast("int")])


def moments(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, sum, sum of squares, min and max in one pass; mean, and std with its floor of 1e-12 in the variance."""
    x = F.col(value).cast("double")
    sums = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    mean = F.col("total") / F.col("n")
    return sums.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(1e-12)))})


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def class_weights(counts: DataFrame, cls: str = "label", n: str = "n", classes: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Inverse-frequency weights divided by their mean. Fails if a class is absent.

    ``counts`` has a row for each class, so the totals are a one-row frame.
    """
    scaffold = counts.sparkSession.createDataFrame([(c,) for c in classes], f"{cls} int")
    full = scaffold.join(counts.select(F.col(cls).cast("int").alias(cls), n), cls, "left").select(cls, F.coalesce(n, F.lit(0)).cast("long").alias(n))
    total = full.agg(F.sum(n).alias("total"), (F.sum(1.0 / F.nullif(F.col(n), F.lit(0))) / len(classes)).alias("mean_inverse"), F.min(n).alias("least"))
    joined = with_scalars(full, total)
    weight = F.when(F.col("least") == 0, F.raise_error(F.lit("a class is absent")).cast("double")).otherwise(1.0 / F.col(n) / F.col("mean_inverse"))
    return joined.select(cls, n, weight.alias("weight"))


def damage_weights(weights: DataFrame, cls: str = "label") -> DataFrame:
    """Weights of the damage classes alone, divided by their mean."""
    some = weights.where(F.col(cls) > 0)
    mean = some.agg(F.avg("weight").alias("mean"))
    return with_scalars(some, mean).select(cls, (F.col("weight") / F.col("mean")).alias("weight"))


def event_audit(tiles: DataFrame, files: list[str] = (), crs: str | None = None, bounds: str | None = None) -> DataFrame:
    """Each event's types, number of tiles, whether every tile has each file, its CRS and bounds."""
    types = F.array_join(F.array_sort(F.collect_set("disaster_type")), ";")
    found = [types.alias("disaster_type"), F.count("*").alias("n_tiles")]
    found += [F.bool_and(F.col(f).isNotNull()).alias(f) for f in files]
    if crs:
        found.append(F.array_join(F.array_sort(F.collect_set(crs)), ";").alias("crs"))
    if bounds:
        found.append(F.bool_and(F.col(bounds).isNotNull()).alias("bounds_available"))
    return tiles.groupBy("event_id").agg(*found)


def type_eligibility(events: DataFrame) -> DataFrame:
    """Events of each type and of the others; a type can be left out if two others remain."""
    counts = events.groupBy("disaster_type").agg(F.count("*").alias("n_events"))
    total = events.agg(F.count("*").alias("total"))
    rows = with_scalars(counts, total)
    others = F.col("total") - F.col("n_events")
    reason = F.when(others >= 2, "two or more events of other types remain for training and validation").otherwise("fewer than two events of other types remain")
    return rows.select("disaster_type", "n_events", others.alias("other_events"), (others >= 2).alias("leave_one_type_out_eligible"), reason.alias("reason"))


def alignment_findings(a: DataFrame, b: DataFrame, key: str = "tile_id", tolerance: float = 1e-6, strict: bool = False) -> DataFrame:
    """Findings on tiles of two modalities: shape and CRS differ (error), bounds differ (warning, or error if ``strict``).

    Both need height, width, crs and bounds (array of four).
    """
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in ("height", "width", "crs", "bounds")])
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in ("height", "width", "crs", "bounds")])
    both = left.join(right, key)
    findings = F.array_compact(
        F.array(
            F.when((F.col("a_height") != F.col("b_height")) | (F.col("a_width") != F.col("b_width")), F.struct(F.lit("shape").alias("what"), F.lit("error").alias("severity"))),
            F.when(~F.col("a_crs").eqNullSafe(F.col("b_crs")), F.struct(F.lit("crs").alias("what"), F.lit("error").alias("severity"))),
            F.when(C.bounds_delta(F.col("a_bounds"), F.col("b_bounds")) > tolerance, F.struct(F.lit("bounds").alias("what"), F.lit("error" if strict else "warning").alias("severity"))),
        )
    )
    return both.select(key, F.explode(findings).alias("f")).select(key, "f.what", "f.severity")


def strict_findings(a: DataFrame, b: DataFrame, bands: tuple[int, int], key: str = "tile_id", tolerance: float = 1e-6) -> DataFrame:
    """What keeps tiles of two inputs from being predicted on together: all of it errors.

    Both need height, width, crs, transform (array of six) and bands; ``bands`` are the numbers that are needed.
    """
    names = ("height", "width", "crs", "transform", "bands")
    both = a.select(key, *[F.col(c).alias(f"a_{c}") for c in names]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in names]), key)
    apart = F.exists(F.zip_with("a_transform", "b_transform", lambda x, y: F.abs(x - y)), lambda d: d > tolerance)
    wrong = {
        "size": (F.col("a_height") != F.col("b_height")) | (F.col("a_width") != F.col("b_width")),
        "crs": F.col("a_crs").isNull() | ~F.col("a_crs").eqNullSafe(F.col("b_crs")),
        "transform": apart,
        "bands": (F.col("a_bands") != bands[0]) | (F.col("b_bands") != bands[1]),
    }
    found = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in wrong.items()]))
    return both.select(key, F.explode(found).alias("what"))


def required_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each name, whether the table has the column, and the number of its values that are not null."""
    has = [c for c in names if c in rows.columns]
    counted = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in has]) if has else rows.limit(0)
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in has).alias("present"), (F.col(f"`{c}`") if c in has else F.lit(0)).cast("long").alias("n_values")) for c in names])
    one = counted if has else counted.sparkSession.range(1)
    return one.select(F.inline(found))
