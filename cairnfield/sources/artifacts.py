"""Checks of folders and tables before a step reads them: layout, completeness, JSON, provenance, partitions.

Folders are listed without their contents; as in Spark's own readers, the names pass through the driver.
What comes back are rows, one for each thing that was asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.sources import files

#: Folders of a root, and the fields that a population raster's origin needs.
FOLDERS = ("pre-event", "post-event", "target")
PROVENANCE = ("population_year", "population_source", "population_version", "population_license", "population_download_date")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, length) of every file below ``root``, empty ones too; names start below it. A root that isn't there has none."""
    try:
        found = files.listing(root, "")
    except FileNotFoundError:
        found = []
    return spark.createDataFrame([(p[len(root.rstrip("/")) + 1 :], n) for p, n in found], "name string, length long")


def layout(found: DataFrame, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """(folder, n_files, complete) of each required folder: it needs a file somewhere below."""
    wanted = found.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    below = found.select(F.substring_index("name", "/", 1).alias("folder")).where(F.col("name").contains("/")).groupBy("folder").agg(F.count("*").alias("n_files"))
    return wanted.join(below, "folder", "left").select("folder", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.col("n_files").isNotNull().alias("complete"))


def require_layout(spark: SparkSession, root: str, folders: tuple[str, ...] = FOLDERS) -> None:
    missing = [r.folder for r in layout(listing(spark, root), folders).where("NOT complete").orderBy("folder").collect()]
    if missing:
        raise ValueError(f"{root} has no files below {', '.join(missing)}")


def completeness(found: DataFrame, required: DataFrame) -> DataFrame:
    """``required`` (artifact, ...) with n_files, bytes and ``complete``: a file that isn't empty, or a folder with such a file below.

    Each file is counted for its own name and for every folder above it, so the artifacts meet them in one equi-join.
    """
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = found.select(F.explode(above).alias("artifact"), "length")
    counted = rows.groupBy("artifact").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    joined = required.join(counted, "artifact", "left")
    return joined.withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))}).withColumn("complete", F.col("bytes") > 0)


def json_state(text: Column) -> Column:
    """missing (null or blank), invalid or valid."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, "missing").when(F.try_parse_json(text).isNull(), "invalid").otherwise("valid")


def json_files(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """(name, text, state) of JSON files below ``root``; tasks read each whole, as such files are small."""
    files.ship(spark)

    def read(batches):
        for batch in batches:
            texts = []
            for name, n in zip(batch.column("name").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with files.Ranged(f"{root.rstrip('/')}/{name}") as data:
                    texts.append(data.read(0, n).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(texts, pa.string())], names=["name", "text"])

    named = listing(spark, root).where(F.col("name").endswith(suffix))
    return named.mapInArrow(read, "name string, text string").withColumn("state", json_state(F.col("text")))


def missing_fields(rows: DataFrame, fields: tuple[str, ...] = PROVENANCE, out: str = "missing") -> DataFrame:
    """Add the names of ``fields`` that are null or blank, or no column at all, in their order."""
    here = set(rows.columns)
    absent = [F.when(F.coalesce(F.trim(F.col(f"`{f}`").cast("string")), F.lit("")) == "", F.lit(f)) if f in here else F.lit(f) for f in fields]
    return rows.withColumn(out, F.array_compact(F.array(*absent)))


def require_fields(rows: DataFrame, fields: tuple[str, ...] = PROVENANCE) -> None:
    """An error that names every field that any row lacks."""
    found = missing_fields(rows.limit(0) if not rows.columns else rows, fields, "__missing").select(F.explode("__missing").alias("f")).distinct().collect()
    lacking = {r.f for r in found}
    if lacking:
        raise ValueError("Required provenance is missing: " + ", ".join(f for f in fields if f in lacking))


def of_partition(rows: DataFrame, value: str = "test", column: str = "partition") -> DataFrame:
    """Rows of one partition where the table has such a column; a table without one stays whole."""
    return rows.where(F.col(f"`{column}`") == value) if column in rows.columns else rows
