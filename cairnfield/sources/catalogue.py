"""Catalogue files: manifests as JSON lines, split files, metrics files, digests, CSV and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.columns import absolute_path, relative_path

#: Modalities and fields of a manifest.
PATHS = ("pre_optical", "post_optical", "pre_sar", "post_sar", "label")
MANIFEST = (
    "event_id string, disaster_type string, tile_id string, pre_optical string, post_optical string, pre_sar string, post_sar string, "
    "label string, crs string, bounds array<double>, metadata struct<source_layout: string, pre_width: int, pre_height: int, pre_bands: int>"
)


def write_manifest(samples: DataFrame, path: str, root: str) -> None:
    """One JSON object on each line, with sorted keys and paths below ``root``."""
    columns = sorted(samples.columns)
    rows = samples.select(*[relative_path(F.col(c), root).alias(c) if c in PATHS else F.col(c) for c in columns])
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Blank lines are skipped; with a root the paths are made absolute."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", MANIFEST).alias("s")).select("s.*")
    return rows if root is None else rows.withColumns({c: absolute_path(F.col(c), root) for c in PATHS})


def modality_files(spark: SparkSession, directory: str, suffix: str, recursive: bool = False) -> DataFrame:
    """tile_id and path of the files of one modality, listed by Spark; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("tile_id"), "path")


def manifest(modalities: dict[str, DataFrame]) -> DataFrame:
    """One row for each tile that all modalities hold. Fails if they don't align or list an id twice."""
    from cairnfield.operators import catalog

    for name, files in modalities.items():
        catalog.require_none(catalog.duplicate_ids(files), f"{name} lists tiles twice")
    catalog.require_none(catalog.misaligned(modalities), "Modalities do not align")
    rows = None
    for name, files in modalities.items():
        part = files.select("tile_id", F.col("path").alias(name))
        rows = part if rows is None else rows.join(part, "tile_id")
    return catalog.parse_tile_ids(rows).withColumnsRenamed({"event": "event_id", "disaster": "disaster_type"})


def write_split(split: DataFrame, path: str) -> None:
    """{"train": [..], "val": [..], "test": [..]} with sorted ids, for small catalogues; one JSON line.

    Larger ones are written by ``write_split_table``.
    """
    parts = [F.array_sort(F.collect_list(F.when(F.col("partition") == p, F.col("tile_id")))).alias(p) for p in ("train", "val", "test")]
    split.agg(*parts).write.json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """tile_id and partition. Fails unless all three lists are there and not empty."""
    rows = spark.read.schema("train array<string>, val array<string>, test array<string>").option("multiLine", "true").json(path)
    bad = rows.where("coalesce(size(train), 0) <= 0 OR coalesce(size(val), 0) <= 0 OR coalesce(size(test), 0) <= 0")
    if bad.limit(1).count():
        raise ValueError("A split file needs non-empty train, val and test lists")
    parts = [rows.select(F.explode(p).alias("tile_id"), F.lit(p).alias("partition")) for p in ("train", "val", "test")]
    return parts[0].union(parts[1]).union(parts[2])


def write_split_table(split: DataFrame, path: str) -> None:
    split.select("tile_id", "event_id", "disaster_type", "partition").write.partitionBy("partition").parquet(path)


def read_official_ids(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three id lists of an official split: trimmed lines that are not blank."""
    found = {}
    for name in ("train", "val", "test"):
        lines = spark.read.text(f"{root}/{name}_set.txt").select(F.trim("value").alias("tile_id"))
        found[name] = lines.where("tile_id <> ''")
    return found


def read_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """Every metrics.json of the runs that exist: run, json."""
    files = spark.read.option("wholetext", "true").text(glob)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run"), F.col("value").alias("json"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of each file, computed where the file is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(published: DataFrame, found: DataFrame) -> DataFrame:
    """Published digests that a folder lacks or contradicts."""
    both = published.alias("p").join(found.alias("f"), F.col("p.name") == F.col("f.name"), "left")
    return both.where(~F.col("p.sha256").eqNullSafe(F.col("f.sha256"))).select(F.col("p.name").alias("name"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def feature(geometry: Column, *properties: str) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    ring = F.array(F.array(minx, miny), F.array(maxx, miny), F.array(maxx, maxy), F.array(minx, maxy), F.array(minx, miny))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


OVERPASS = (
    "struct<elements: array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, "
    "geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>>"
)
#: Amenities that count as facilities.
AMENITIES = ("hospital", "clinic", "fire_station", "police")


def overpass_elements(documents: DataFrame, column: str = "json") -> DataFrame:
    """Elements of map-service documents, one row each."""
    return documents.select(F.explode(F.from_json(F.col(column), OVERPASS)["elements"]).alias("e")).select("e.*")


def overpass_roads(elements: DataFrame) -> DataFrame:
    """Ways with a highway tag and two nodes or more: osm_id, highway, name, coords."""
    rows = elements.where((F.col("type") == "way") & F.col("tags")["highway"].isNotNull() & (F.size("geometry") >= 2))
    coords = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return rows.select(F.col("id").alias("osm_id"), F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name"), coords.alias("coords"))


def overpass_facilities(elements: DataFrame) -> DataFrame:
    """Elements with a facility's amenity or an emergency tag, at their point or centre."""
    amenity = F.col("tags")["amenity"]
    kind = F.when(amenity.isin(*AMENITIES), amenity).otherwise(F.col("tags")["emergency"])
    rows = elements.withColumns({"facility_type": kind, "x": F.coalesce("lon", "center.lon"), "y": F.coalesce("lat", "center.lat")})
    return rows.where("facility_type IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select(F.col("id").alias("osm_id"), "facility_type", F.col("tags")["name"].alias("name"), "x", "y")


def population_check(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Counts of negative and missing values, and the sum of the others: one row."""
    v = F.col(value).cast("double")
    return pixels.agg(F.count_if(v < 0).alias("n_negative"), F.count_if(v.isNull() | F.isnan(v)).alias("n_missing"), F.sum(F.when(~F.isnan(v), F.greatest(v, F.lit(0.0)))).alias("total"))
