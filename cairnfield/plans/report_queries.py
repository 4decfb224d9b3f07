"""Queries on reports, file formats and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import metrics, reports
from cairnfield.plans import catalogue_queries, metric_queries, priority_queries
from cairnfield.plans.analogues import load, pixels, softmax_sql, tiles, with_sql
from cairnfield.sources import catalogue
from cairnfield.streaming import metrics as streams

TEMPERATURE = metric_queries.TEMPERATURE


def json_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.from_json("props", "map<string,int>")
    return load(spark, sf_dir, "events").select("event_id", F.explode(tags).alias("tag", "v")).where("v > 50")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map-service documents, one for each nation: ways and nodes drawn from suppliers."""
    k = F.col("s_suppkey")
    way = F.struct(
        F.when(k % 3 == 0, "node").otherwise("way").alias("type"),
        k.alias("id"),
        F.when(k % 3 == 0, k / 10.0).alias("lat"),
        F.when(k % 3 == 0, k / 20.0).alias("lon"),
        F.when(k % 3 == 1, F.array(F.struct((k / 10.0).alias("lat"), (k / 20.0).alias("lon")), F.struct((k / 10.0 + 1).alias("lat"), (k / 20.0).alias("lon")))).alias("geometry"),
        F.when(k % 3 == 1, F.create_map(F.lit("highway"), F.lit("primary"), F.lit("name"), F.col("s_name"))).when(k % 6 == 0, F.create_map(F.lit("amenity"), F.lit("hospital"))).when(k % 9 == 0, F.create_map(F.lit("emergency"), F.lit("siren"))).otherwise(F.create_map(F.lit("amenity"), F.lit("cafe"))).alias("tags"),
    )
    rows = load(spark, sf_dir, "supplier").select("s_nationkey", way.alias("e"))
    return rows.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("json"))


def overpass_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.overpass_roads(catalogue.overpass_elements(_documents(spark, sf_dir)))
    return rows.select("osm_id", "highway", "name", F.size("coords").alias("n"), F.round(F.col("coords")[1]["y"], 6).alias("y1"))


def overpass_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.overpass_facilities(catalogue.overpass_elements(_documents(spark, sf_dir)))
    return rows.select("osm_id", "facility_type", *[F.round(c, 6).alias(c) for c in "xy"])


def population_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.population_check(load(spark, sf_dir, "events")).select("n_negative", "n_missing", F.round("total", 4).alias("total"))


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written as JSON lines with relative paths, and read back under another root."""
    t = tiles(spark, sf_dir)
    paths = {c: F.concat(F.lit(f"/data/{c}/"), "tile_id", F.lit(".tif")) for c in ("pre_optical", "post_sar", "label")}
    none = F.lit(None).cast("string")
    rows = t.select("event_id", "disaster_type", "tile_id", *[paths.get(c, none).alias(c) for c in catalogue.PATHS], F.lit("EPSG:32632").alias("crs"), F.array(F.col("value"), F.col("value") + 1).alias("bounds"), F.struct(F.lit("flat").alias("source_layout"), F.lit(10).alias("pre_width"), F.lit(12).alias("pre_height"), F.lit(3).alias("pre_bands")).alias("metadata"))
    folder = streams.shared_folder(spark)
    catalogue.write_manifest(rows, folder, "/data")
    back = catalogue.read_manifest(spark, folder, "/mnt")
    return back.select("tile_id", "event_id", "label", F.coalesce("pre_sar", F.lit("none")).alias("pre_sar"), F.round(F.col("bounds")[1], 4).alias("b1"), F.col("metadata.pre_bands").alias("bands"))


def split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = streams.shared_folder(spark)
    catalogue.write_split(catalogue_queries.official_split(spark, sf_dir), folder)
    return catalogue.read_split(spark, folder)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = streams.shared_folder(spark)
    catalogue.write_csv(catalogue_queries.events_audit(spark, sf_dir).select("event_id", "disaster_type", "n_tiles"), folder)
    return catalogue.read_csv(spark, folder, "event_id string, disaster_type string, n_tiles long")


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as GeoJSON text; type, corners and properties are parsed back from it."""
    cells = priority_queries.decision_grid(spark, sf_dir)
    text = cells.select(catalogue.feature(catalogue.box(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]), "cell_id").alias("f"))
    schema = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<cell_id: string>"
    f = text.select(F.from_json("f", schema).alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return f.select("f.properties.cell_id", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("shape"), F.size(ring).alias("n"), ring[2][0].alias("x2"), ring[2][1].alias("y2"))


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.digests(spark, f"{sf_dir}/nation.parquet")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of models under two protocols, scored on events: accuracy of two halves of the pixels."""
    rows = pixels(spark, sf_dir).withColumn("pred", F.array_position("logits", F.array_max("logits")) - 1)
    half = F.when(F.col("vec_id") % 3 == 0, "m3_holdout").otherwise("m3_standard")
    scored = metrics.from_confusion(rows.groupBy(half.alias("run"), "event_id", "target", "pred").agg(F.count("*").alias("n")), ["run", "event_id"])
    return scored.withColumns({"protocol": reports.protocol(F.col("run")), "model": F.substring_index("run", "_", 1)})


def heldout_vs_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    rows = reports.heldout_vs_standard(runs.where("protocol = 'event_held_out'"), runs.where("protocol = 'standard'"), ["model", "event_id"], ["accuracy"])
    return rows.select("model", "event_id", *[F.round(F.coalesce(c, F.lit(-9.0)), 6).alias(c) for c in ("heldout_accuracy", "standard_accuracy", "gap_accuracy")])


def ablation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode's accuracy against the best run of the full mode, the first of several."""
    rows = pixels(spark, sf_dir).withColumn("pred", F.array_position("logits", F.array_max("logits")) - 1)
    mode = F.element_at(F.array(*map(F.lit, ("full", "sar_only", "optical_only"))), (F.col("vec_id") % 3 + 1).cast("int"))
    runs = metrics.from_confusion(rows.groupBy(mode.alias("mode"), (F.col("vec_id") % 2).alias("run"), "target", "pred").agg(F.count("*").alias("n")), ["mode", "run"])
    full = reports.first_counterpart(runs.where("mode = 'full'").withColumn("k", F.lit(1)), ["k"], "run").select("k", F.col("accuracy").alias("full_accuracy"))
    both = runs.withColumn("k", F.lit(1)).join(full, "k", "left")
    return both.select("mode", "run", reports.modality(F.col("mode")).alias("modality"), F.round("accuracy", 6).alias("accuracy"), F.round(F.col("full_accuracy") - F.col("accuracy"), 6).alias("gap"))


def missing_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("fusion_mode")).distinct()
    return reports.missing_modes(found, ["automobile", "building", "late_fusion", "machinery", "sar_only"])


def metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric at the top of a JSON text or below ``pooled``, with its interval where there is one."""
    e = load(spark, sf_dir, "events")
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("value").alias("miou")))).otherwise(F.to_json(F.struct(F.struct(F.col("value").alias("miou")).alias("pooled"))))
    lower, upper = F.when(F.col("event_id") % 3 == 0, 0.25), F.when(F.col("event_id") % 3 == 0, 0.5)
    return e.select("event_id", F.round(reports.metric(payload, "miou"), 6).alias("miou"), reports.interval(lower, upper).alias("ci"))


def per_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("event_id"), (F.col("o_totalprice") / 1e6).alias("miou"), F.lit(0.5).alias("f1_damage")))).alias("per_event"))
    model = F.when(F.col("o_custkey") % 2 == 0, "unet")
    text = rows.select(F.to_json(F.struct(model.alias("model"), "per_event")).alias("json"))
    return reports.per_event_rows(text).select("protocol", "model", "event_id", F.round("miou", 6).alias("miou"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_discount"), 6).alias("val_f1_damage"))


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_epoch(_history(spark, sf_dir), ["run"])


def records_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.records_so_far(_history(spark, sf_dir), ["run"], "val_f1_damage")


def streaming_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.stream(spark, f"{sf_dir}/embeddings.parquet")
    logits = F.array(*[F.get("embedding", i).cast("double") for i in range(4)])
    rows = streams.prediction(e.select((F.col("vec_id") % 8).alias("event_id"), (F.col("label") % 4).alias("target"), logits.alias("logits")))
    return streams.drained(streams.confusion(rows))


def streaming_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.stream(spark, f"{sf_dir}/embeddings.parquet")
    logits = F.array(*[F.get("embedding", i).cast("double") for i in range(3)])
    rows = e.select((F.col("label") % 3).alias("target"), logits.alias("logits"))
    return streams.drained(streams.calibration_bins(rows, TEMPERATURE)).select("bin", "count", "correct", F.round("confidence", 6).alias("confidence"))


def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = streams.drained(streams.windows(streams.stream(spark, f"{sf_dir}/events.parquet"), "6 hours"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.drained(streams.sessions(streams.stream(spark, f"{sf_dir}/events.parquet")))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (json_tags, overpass_roads, overpass_facilities, population_check, manifest_roundtrip, split_roundtrip, csv_roundtrip, geojson_features, file_digests, heldout_vs_standard, ablation_gap, missing_modes, metric_lookup, per_event_rows, best_epoch, records_so_far, streaming_confusion, streaming_calibration, streaming_windows, streaming_sessions)}

_H = "h AS (SELECT l_suppkey % 10 AS run, l_linenumber AS epoch, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY 1, 2)"
_HIT = "CASE WHEN list_position(logits, list_max(logits)) - 1 = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
ORACLES = {
    "json_tags": "SELECT event_id, 'k' AS tag, CAST(json_extract(props, '$.k') AS INTEGER) AS v FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50",
    "overpass_roads": "SELECT s_suppkey AS osm_id, 'primary' AS highway, s_name AS name, 2 AS n, round(s_suppkey / 10.0::DOUBLE + 1, 6) AS y1 FROM supplier WHERE s_suppkey % 3 = 1",
    "overpass_facilities": "SELECT s_suppkey AS osm_id, CASE WHEN s_suppkey % 6 = 0 THEN 'hospital' ELSE 'siren' END AS facility_type, round(s_suppkey / 20.0::DOUBLE, 6) AS x, round(s_suppkey / 10.0::DOUBLE, 6) AS y FROM supplier WHERE s_suppkey % 3 = 0 AND (s_suppkey % 6 = 0 OR s_suppkey % 9 = 0)",
    "population_check": "SELECT count(*) FILTER (WHERE value < 0) AS n_negative, count(*) FILTER (WHERE value IS NULL) AS n_missing, round(sum(greatest(value, 0)), 4) AS total FROM events",
    "manifest_roundtrip": with_sql("tiles") + " SELECT tile_id, event_id, '/mnt/label/' || tile_id || '.tif' AS label, 'none' AS pre_sar, round(value + 1, 4) AS b1, 3 AS bands FROM tiles",
    "split_roundtrip": with_sql("tiles") + " SELECT tile_id, CASE WHEN ordinal % 10 < 6 THEN 'train' WHEN ordinal % 10 = 7 THEN 'val' ELSE 'test' END AS partition FROM tiles WHERE ordinal % 10 < 6 OR ordinal % 10 IN (7, 8)",
    "csv_roundtrip": with_sql("tiles") + " SELECT event_id, min(disaster_type) AS disaster_type, count(*) AS n_tiles FROM tiles GROUP BY 1",
    "geojson_features": f"{priority_queries._G} SELECT cell_id, 'Feature' AS kind, 'Polygon' AS shape, 5 AS n, minx + 500.0 AS x2, miny + 500.0 AS y2 FROM grid",
    "heldout_vs_standard": f"""{with_sql('pixels')}, a AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'h' ELSE 's' END AS run, event_id, avg({_HIT}) AS acc FROM pixels GROUP BY 1, 2)
SELECT 'm3' AS model, h.event_id, round(h.acc, 6) AS heldout_accuracy, round(coalesce(s.acc, -9), 6) AS standard_accuracy, round(coalesce(s.acc - h.acc, -9), 6) AS gap_accuracy
FROM (SELECT * FROM a WHERE run = 'h') h LEFT JOIN (SELECT * FROM a WHERE run = 's') s ON h.event_id = s.event_id""",
    "ablation_gap": f"""{with_sql('pixels')}, a AS (SELECT ['full', 'sar_only', 'optical_only'][vec_id % 3 + 1] AS mode, vec_id % 2 AS run, avg({_HIT}) AS acc FROM pixels GROUP BY 1, 2)
SELECT mode, run, CASE mode WHEN 'full' THEN 'multimodal' WHEN 'sar_only' THEN 'sar' ELSE 'optical' END AS modality, round(acc, 6) AS accuracy, round((SELECT acc FROM a WHERE mode = 'full' ORDER BY run LIMIT 1) - acc, 6) AS gap FROM a""",
    "missing_modes": "SELECT unnest(['automobile', 'building', 'late_fusion', 'machinery', 'sar_only']) AS fusion_mode EXCEPT SELECT lower(c_mktsegment) FROM customer",
    "metric_lookup": "SELECT event_id, round(value, 6) AS miou, CASE WHEN event_id % 3 = 0 THEN '[0.250, 0.500]' ELSE 'not available' END AS ci FROM events",
    "per_event_rows": "SELECT 'unknown' AS protocol, CASE WHEN o_custkey % 2 = 0 THEN 'unet' ELSE 'unknown' END AS model, CAST(o_orderkey AS VARCHAR) AS event_id, round(o_totalprice / 1e6, 6) AS miou FROM orders",
    "best_epoch": f"WITH {_H} SELECT run, epoch, v AS val_f1_damage FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY v DESC, epoch) AS r FROM h) WHERE r = 1",
    "records_so_far": f"WITH {_H} SELECT run, epoch, v AS val_f1_damage, v > coalesce(max(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM h",
    "streaming_confusion": f"{with_sql('pixels')} SELECT event_id, target, list_position(logits, list_max(logits)) - 1 AS pred, count(*) AS n FROM pixels GROUP BY 1, 2, 3",
    "streaming_calibration": f"""{with_sql('scored_buildings')}, p AS (SELECT target, {softmax_sql('logits', 3, str(TEMPERATURE))} AS p FROM scored_buildings)
SELECT CAST({metric_queries._bin('list_max(p)')} AS INTEGER) AS bin, count(*) AS count, CAST(sum(CASE WHEN list_position(p, list_max(p)) - 1 = target THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(sum(list_max(p)), 6) AS confidence FROM p GROUP BY 1""",
    "streaming_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "streaming_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
}
