"""Queries on files that are made from the tables, each read back through its own source, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators import chunks, metrics
from cairnfield.plans.analogues import _u, load
from cairnfield.sources import artifacts, blocks, bundles, files, raster
from cairnfield.streaming.metrics import shared_folder

#: Pixels along a side of a tile of events, of its blocks, and bands.
SIDE, BLOCK, CLASSES = 48, 16, 4
AREA = SIDE * SIDE
#: Rows and columns of the windowed read: top, left, bottom, right.
WINDOW = (10, 5, 31, 40)


def _tiles(spark: SparkSession, sf_dir: str, pixel: Column) -> DataFrame:
    """(tile, p): an array of the AREA pixels of each tile of events, in row order; null where there is no event."""
    e = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / AREA).cast("long").alias("tile"), (F.col("event_id") % AREA).cast("int").alias("k"), pixel.alias("v"))
    frame = e.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(AREA - 1))).alias("k"))
    rows = frame.join(e, ["tile", "k"], "left").groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("all"))  # AREA entries each
    return rows.select("tile", F.transform("all", lambda p: p["v"]).alias("p"))


def _rasters(spark: SparkSession, sf_dir: str) -> str:
    """A TIFF of two bands (value, user) for each tile: in blocks or strips, deflated or not. Returns the folder."""
    files.ship(spark)
    pixel = F.struct("value", F.col("user_id").cast("double").alias("user"))
    rows = _tiles(spark, sf_dir, pixel).select("tile", F.transform("p", lambda p: p["value"]).alias("value"), F.transform("p", lambda p: p["user"]).alias("user"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for i, tile in enumerate(batch.column("tile").to_pylist()):
                bands = [batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(SIDE, SIDE) for c in ("value", "user")]
                names.append(f"{tile % 7}/tile_{tile:08d}.tif")
                bodies.append(raster.encode(np.stack(bands), block=BLOCK if tile % 2 else 0, deflate=tile % 3 > 0, crs=32632, bounds=(0.0, 0.0, 480.0, 480.0), strip=10))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies, pa.binary())], names=["name", "content"])

    folder = shared_folder(spark)
    files.write_files(rows.mapInArrow(write, "name string, content binary"), folder)
    return folder


def raster_block_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of every band over all tiles, read strip by strip and block by block."""
    found = blocks.moments(blocks.blocks(spark, _rasters(spark, sf_dir), channels=2), "band")
    return found.select("band", "n", *[F.round(c, 4).alias(c) for c in ("total", "squares", "min", "max", "mean", "std")])


def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one band inside a window of each tile."""
    rows = blocks.blocks(spark, _rasters(spark, sf_dir), window=WINDOW).where("band = 0")
    tile = F.regexp_extract("path", r"tile_(\d+)", 1).cast("long").alias("tile")
    return blocks.moments(rows.withColumn("tile", tile), "tile").select("tile", "n", F.round("total", 4).alias("total"))


def _entry(c: int):
    return lambda z: z[c]


def _bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of predictions: logits of four classes drawn for each event, and a mask that ignores some."""
    key = F.col("event_id")
    z = F.array(*[(4 * C.uniform(f"z{c}", key)).cast("float") for c in range(CLASSES)])
    label = F.when(key % 11 == 0, 255).otherwise((F.col("user_id") % CLASSES).cast("int"))
    t = _tiles(spark, sf_dir, F.struct(z.alias("z"), label.alias("label")))
    z = F.transform("p", lambda p: F.coalesce(p["z"], F.array_repeat(F.lit(0.0).cast("float"), CLASSES)))
    logits = F.flatten(F.array(*[F.transform(z, _entry(c)) for c in range(CLASSES)]))
    mask = F.transform("p", lambda p: F.coalesce(p["label"], F.lit(255)))
    name = F.concat(F.lit("event-"), F.col("tile") % 3)
    none = F.lit(None)
    return t.select(name.alias("event_id"), F.concat(name, F.lit("_"), F.lpad(F.col("tile").cast("string"), 8, "0")).alias("tile_id"), F.lit("EPSG:32632").alias("crs"), none.cast("array<double>").alias("bounds"), F.lit(0).alias("block"), F.lit(0).alias("row"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(CLASSES).alias("classes"), logits.alias("logits"), mask.alias("mask"))


def _bundles(spark: SparkSession, sf_dir: str, compress: bool) -> DataFrame:
    folder = shared_folder(spark)
    bundles.write_bundles(_bundled(spark, sf_dir), folder, compress)
    return bundles.read_bundles(spark, folder, block_pixels=7 * SIDE)


def bundle_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles written and read back; logits met with masks by (tile, block), and counted there."""
    read = _bundles(spark, sf_dir, compress=True)
    counts = chunks.confusion(read.drop("mask"), read.select("tile_id", "block", "mask"), CLASSES)
    return counts.withColumn("event_id", F.coalesce("event_id", F.lit("pooled")))


def bundle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation metrics of stored bundles, by event and pooled."""
    read = _bundles(spark, sf_dir, compress=False)
    counts = chunks.confusion(read.drop("mask"), read.select("tile_id", "block", "mask"), CLASSES)
    found = metrics.from_confusion(counts, classes=CLASSES)
    return found.select(F.coalesce("event_id", F.lit("pooled")).alias("event_id"), "n_pixels", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


def bundle_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels behind the positional join: the mean logit of the true class in each row of a tile."""
    read = _bundles(spark, sf_dir, compress=True)
    rows = chunks.pixels(chunks.aligned(read.drop("mask"), read.select("tile_id", "block", "mask"), CLASSES), CLASSES).where("target <> 255")
    own = F.get("logits", F.col("target"))
    return rows.groupBy("tile_id", "row").agg(F.count("*").alias("n"), F.round(F.avg(own), 5).alias("mean_logit"))


def _outputs(spark: SparkSession, sf_dir: str) -> str:
    """Outputs of runs, one folder for each supplier: metrics that are valid, broken or empty, and masks that some lack."""
    k = F.col("s_suppkey")
    run = F.concat(F.lit("run_"), k.cast("string"))
    body = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit('{"run": '), k.cast("string"))).otherwise(F.to_json(F.struct(k.alias("run"), F.col("s_acctbal").alias("score"))))
    text = F.struct(F.concat(run, F.lit("/metrics.json")).alias("name"), body.cast("binary").alias("content"))
    masks = F.struct(F.concat(run, F.lit("/masks/m.bin")).alias("name"), F.when(k % 4 == 1, F.lit("")).otherwise("mask").cast("binary").alias("content"))
    each = F.when(k % 4 == 0, F.array(text)).otherwise(F.array(text, masks))
    folder = shared_folder(spark)
    files.write_files(load(spark, sf_dir, "supplier").select(F.explode(each).alias("f")).select("f.*"), folder)
    return folder


def artifact_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which outputs each run has: metrics and a folder of masks, neither of them empty."""
    run = F.concat(F.lit("run_"), F.col("s_suppkey").cast("string"))
    asked = load(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(run, F.lit("/metrics.json")), F.concat(run, F.lit("/masks")))).alias("artifact"))
    found = artifacts.completeness(artifacts.listing(spark, _outputs(spark, sf_dir)), asked)
    return found.select("artifact", "n_files", "complete")


def json_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.json_files(spark, _outputs(spark, sf_dir)).select("name", "state")


def root_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by market segment: how many files each required one has."""
    c = load(spark, sf_dir, "customer")
    name = F.concat(F.lower("c_mktsegment"), F.lit("/"), (F.col("c_custkey") % 9).cast("string"), F.lit("/tile.txt"))
    folder = shared_folder(spark)
    files.write_files(c.select(name.alias("name")).distinct().withColumn("content", F.lit(b"x")), folder)
    return artifacts.layout(artifacts.listing(spark, folder), ("automobile", "building", "pre-event"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of origin that rows lack, or that have no column at all."""
    k = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 3 > 0, F.lit("2020")).alias("population_year"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("population_source"), F.when(k % 5 == 0, F.lit("")).otherwise("v1").alias("population_version"), F.lit("open").alias("population_license")
    )
    return artifacts.missing_fields(rows).select("id", F.array_join("missing", ",").alias("missing"))


def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a partition column, and the same without: which of their rows stay."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "test").when(F.col("o_orderkey") % 3 == 1, "train").alias("partition"))
    some = artifacts.of_partition(o).select("o_orderkey", F.lit("with").alias("kind"))
    return some.union(artifacts.of_partition(o.drop("partition")).select("o_orderkey", F.lit("without").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


QUERIES = {f.__name__: f for f in (raster_block_moments, raster_window, bundle_confusion, bundle_metrics, bundle_pixels, artifact_completeness, json_states, root_layout, provenance, partition_filter)}

_BANDS = "bands AS (SELECT event_id // {a} AS tile, event_id % {a} // {s} AS r, event_id % {s} AS c, value, CAST(user_id AS DOUBLE) AS usr FROM events)".format(a=AREA, s=SIDE)
_LOGITS = ", ".join(f"CAST(4 * {_u(f'z{c}', 'event_id')} AS FLOAT)" for c in range(CLASSES))
_PIXELS = f"""pixels AS (
  SELECT 'event-' || (event_id // {AREA}) % 3 AS event, 'event-' || (event_id // {AREA}) % 3 || '_' || lpad(CAST(event_id // {AREA} AS VARCHAR), 8, '0') AS tile_id,
    CAST(event_id % {AREA} // {SIDE} AS INTEGER) AS "row", user_id % {CLASSES} AS target, [{_LOGITS}] AS z FROM events WHERE event_id % 11 <> 0),
scored AS (SELECT *, list_position(z, list_max(z)) - 1 AS pred FROM pixels),
grouped AS (SELECT event, target, pred FROM scored UNION ALL SELECT 'pooled', target, pred FROM scored),
every AS (SELECT e.event, k // {CLASSES} AS target, k % {CLASSES} AS pred FROM (SELECT DISTINCT 'event-' || (event_id // {AREA}) % 3 AS event FROM events UNION SELECT 'pooled') e, range({CLASSES * CLASSES}) t(k)),
counts AS (SELECT v.event AS event_id, CAST(v.target AS INTEGER) AS target, CAST(v.pred AS INTEGER) AS pred, count(g.event) AS n FROM every v LEFT JOIN grouped g ON g.event = v.event AND g.target = v.target AND g.pred = v.pred GROUP BY ALL)"""


def _class(k: int) -> tuple[str, str, str]:
    tp = f"sum(n) FILTER (WHERE target = {k} AND pred = {k})"
    s, p = f"sum(n) FILTER (WHERE target = {k})", f"sum(n) FILTER (WHERE pred = {k})"
    return s, f"({tp} / greatest({s} + {p} - {tp}, 1.0::DOUBLE))", f"(2.0::DOUBLE * {tp} / greatest({s} + {p}, 1.0::DOUBLE))"


def _mean(of: int, ks: range) -> str:
    total = " + ".join(f"CASE WHEN {_class(k)[0]} > 0 THEN {_class(k)[of]} ELSE 0 END" for k in ks)
    n = " + ".join(f"CASE WHEN {_class(k)[0]} > 0 THEN 1 ELSE 0 END" for k in ks)
    return f"round(coalesce(({total}) / nullif({n}, 0), 0), 6)"


ORACLES = {
    "raster_block_moments": f"""WITH {_BANDS}, v AS (SELECT 0 AS band, value AS x FROM bands UNION ALL SELECT 1, usr FROM bands)
SELECT CAST(band AS INTEGER) AS band, count(x) AS n, round(sum(x), 4) AS total, round(sum(x * x), 4) AS squares, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(sqrt(greatest(sum(x * x) / count(x) - avg(x) * avg(x), 1e-12)), 4) AS std FROM v GROUP BY 1""",
    "raster_window": f"""WITH {_BANDS} SELECT tile, count(x) AS n, round(coalesce(sum(x), 0.0), 4) AS total
FROM (SELECT tile, CASE WHEN r >= {WINDOW[0]} AND c >= {WINDOW[1]} AND r < {WINDOW[2]} AND c < {WINDOW[3]} THEN value END AS x FROM bands) GROUP BY 1""",
    "bundle_confusion": f"WITH {_PIXELS} SELECT * FROM counts",
    "bundle_metrics": f"""WITH {_PIXELS} SELECT event_id, CAST(sum(n) AS BIGINT) AS n_pixels,
  round(sum(n) FILTER (WHERE target = pred) / greatest(sum(n), 1.0::DOUBLE), 6) AS accuracy, {_mean(1, range(CLASSES))} AS miou, {_mean(2, range(CLASSES))} AS macro_f1,
  round(2.0::DOUBLE * sum(n) FILTER (WHERE target = pred AND target > 0) / greatest(sum(n) FILTER (WHERE target > 0) + sum(n) FILTER (WHERE pred > 0), 1.0::DOUBLE), 6) AS f1_localization, {_mean(2, range(1, CLASSES))} AS f1_damage
FROM counts GROUP BY 1""",
    "bundle_pixels": f"""WITH {_PIXELS} SELECT tile_id, "row", count(*) AS n, round(avg(CAST(z[target + 1] AS DOUBLE)), 5) AS mean_logit FROM pixels GROUP BY 1, 2""",
    "artifact_completeness": """SELECT 'run_' || s_suppkey || '/metrics.json' AS artifact, 1 AS n_files, s_suppkey % 5 <> 0 AS complete FROM supplier
UNION ALL SELECT 'run_' || s_suppkey || '/masks', CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END, s_suppkey % 4 > 1 FROM supplier""",
    "json_states": "SELECT 'run_' || s_suppkey || '/metrics.json' AS name, CASE s_suppkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' ELSE 'valid' END AS state FROM supplier",
    "root_layout": "SELECT f AS folder, count(DISTINCT c_custkey % 9) AS n_files, count(c_custkey) > 0 AS complete FROM (VALUES ('automobile'), ('building'), ('pre-event')) t(f) LEFT JOIN customer ON lower(c_mktsegment) = f GROUP BY 1",
    "provenance": """SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'population_year' END, CASE WHEN p_partkey % 4 = 0 THEN 'population_source' END, CASE WHEN p_partkey % 5 = 0 THEN 'population_version' END, 'population_download_date') AS missing FROM part""",
    "partition_filter": "SELECT 'with' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'without', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders",
}
