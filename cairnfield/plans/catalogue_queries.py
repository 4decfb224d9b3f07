"""Queries on the tile catalogue, splits and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators import catalog, graph, splits
from cairnfield.plans.analogues import load, sql_uniform, tiles, with_sql

SAMPLE_DRAWS, COVERAGE_TILES, CROP = 500, 5, 64


def _split_events(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[str]]:
    """The last event in order is held out, the one before it validates."""
    events = [r[0] for r in tiles(spark, sf_dir).select("event_id").distinct().orderBy(F.desc("event_id")).limit(2).collect()]
    return events[1:], events[:1]


def tile_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tile_id"))
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tile_id")).distinct()
    return catalog.misaligned({"pre": orders, "post": lines})


def tile_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parse_tile_ids(tiles(spark, sf_dir).select("tile_id")).select("tile_id", "event", "disaster", "number", "valid")


def label_domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select((F.col("quality") + 2 * F.col("toxic")).alias("label"))
    return catalog.label_violations(labels, "label", {0, 1, 2})


def class_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic") + F.when(F.col("doc_id") % 10 == 0, 2).otherwise(0)).alias("label"))
    return catalog.class_names(labels, "label")


def audit_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.moments(load(spark, sf_dir, "events"), ["event_type"], "value")
    return m.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("total", "min", "max", "mean", "std")])


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def tiles_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(tiles(spark, sf_dir), "event_id")


def modality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_type").alias("modality"), (F.col("p_size") % 4).cast("int").alias("band"))
    return catalog.histogram(p, "modality", "band")


def _class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    return catalog.histogram(load(spark, sf_dir, "lineitem").select(cls.alias("label")), "label")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.class_weights(_class_counts(spark, sf_dir)).select("label", "n", F.round("weight", 6).alias("weight"))


def damage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = catalog.damage_weights(catalog.class_weights(_class_counts(spark, sf_dir)))
    return w.select("label", F.round("weight", 6).alias("weight"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    return catalog.event_audit(
        t.withColumns({"post": F.when(F.col("value") >= -900, F.col("tile_id")), "crs": F.concat(F.lit("EPSG:326"), F.lpad((F.col("ordinal") % 2 + 32).cast("string"), 2, "0")), "bounds": F.col("value")}),
        ["post"], "crs", "bounds",
    )


def events_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


def type_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.type_eligibility(_audited(spark, sf_dir))


def alignment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    n = F.col("ordinal")
    pre = t.select("tile_id", F.lit(12).alias("height"), F.lit(10).alias("width"), F.lit("EPSG:32632").alias("crs"), F.array(*[(n * 10 + k).cast("double") for k in (0, 0, 10, 10)]).alias("bounds"))
    post = t.select(
        "tile_id",
        F.when(n % 50 == 0, 13).otherwise(12).alias("height"),
        F.lit(10).alias("width"),
        F.when(n % 70 == 0, "EPSG:32633").otherwise("EPSG:32632").alias("crs"),
        F.array(*[(n * 10 + k + F.when(n % 30 == 0, 10).otherwise(0)).cast("double") for k in (0, 0, 10, 10)]).alias("bounds"),
    )
    return catalog.alignment_findings(pre, post)


def event_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _split_events(spark, sf_dir)
    return splits.holdout_split(tiles(spark, sf_dir), val, test).select("tile_id", "event_id", "partition")


def standard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.standard_split(tiles(spark, sf_dir)).select("tile_id", "event_id", "partition")


def _official_ids(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = tiles(spark, sf_dir)
    n = F.col("ordinal") % 10
    ids = {"train": t.where(n < 6), "val": t.where(n == 7), "test": t.where(n == 8)}
    return {k: v.select(F.concat(F.lit(" "), "tile_id", F.lit(" ")).alias("tile_id")) for k, v in ids.items()}


def official_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.official_split(tiles(spark, sf_dir), _official_ids(spark, sf_dir)).select("tile_id", "event_id", "partition")


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the official split that are in more than one partition."""
    return splits.leakage(official_split(spark, sf_dir))


def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_suppkey") % 9 == 0, 1_000_000).otherwise(0)).alias("id"))
    return splits.unknown_ids(wanted, load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id")


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balanced_sample(tiles(spark, sf_dir), SAMPLE_DRAWS)


def greedy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in the order in which they are chosen (customers by segment counts of their orders)."""
    o = load(spark, sf_dir, "orders")
    n = [F.count_if(F.col("o_orderstatus") == s).alias(f"c{i}") for i, s in enumerate("FOP")]
    counts = o.groupBy(F.col("o_custkey").alias("tile_id")).agg(*n)
    chosen = splits.greedy_coverage(counts, ["c0", "c1", "c2"], COVERAGE_TILES)
    return spark.createDataFrame([(i, t) for i, t in enumerate(chosen)], "place int, tile_id long")


def validation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    test = t.agg(F.max("event_id")).first()[0]
    rest = t.where(F.col("event_id") != test)
    return rest.agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def geometry_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") + 60).alias("h"), (F.col("p_size") + 64).alias("w"))
    return splits.geometry_plan(t, "i", "h", "w", CROP)


def centre_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") + 60).alias("h"), (F.col("p_size") + 64).alias("w"))
    return splits.geometry_plan(t, "i", "h", "w", CROP, randomise=False).select("i", "top", "left")


def path_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tiles(spark, sf_dir).select("tile_id", F.concat(F.lit("/data/tiles/pre-event/"), "tile_id", F.lit("_pre.tif")).alias("path"))
    relative = C.relative_path(F.col("path"), "/data/tiles")
    return p.select("tile_id", relative.alias("relative"), C.absolute_path(relative, "/mnt/copy").alias("absolute"))


def strict_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs of each tile, of which some differ in size, reference system, transform or bands."""
    t, n = tiles(spark, sf_dir), F.col("ordinal")

    def side(height, crs, x, bands):
        return t.select("tile_id", height.alias("height"), F.lit(10).alias("width"), crs.alias("crs"), F.array(*[v.cast("double") for v in (F.lit(2), F.lit(0), x, F.lit(0), F.lit(-2), n)]).alias("transform"), bands.alias("bands"))

    pre = side(F.lit(12), F.when(n % 80 != 0, "EPSG:32721"), n * 20, F.lit(3))
    post = side(F.when(n % 50 == 0, 13).otherwise(12), F.when(n % 80 != 0, F.when(n % 70 == 0, "EPSG:32722").otherwise("EPSG:32721")), n * 20 + F.when(n % 30 == 0, 1).otherwise(0), F.when(n % 90 == 0, 2).otherwise(1))
    return catalog.strict_findings(pre, post, (3, 1))


def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.required_columns(load(spark, sf_dir, "supplier").withColumn("mask", F.when(F.col("s_suppkey") % 4 == 0, 1)), ["s_suppkey", "mask", "geometry"])


def test_partition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.official_split(tiles(spark, sf_dir), _official_ids(spark, sf_dir))
    wanted = load(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("event_id"))
    return splits.partition_mismatch(split, wanted)


def pooled_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.official_split(tiles(spark, sf_dir), _official_ids(spark, sf_dir))
    return splits.pooled(split, ["val", "test", "val"]).groupBy("event_id").agg(F.count("*").alias("n_rows"), F.count_distinct("tile_id").alias("n_tiles"))


def road_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of up to four vertices, of which some repeat and some have no length, as segments."""
    k = F.col("s_suppkey")
    vertex = [F.struct((k * a % 7).cast("double").alias("x"), (k * b % 5).cast("double").alias("y")) for a, b in ((1, 1), (2, 3), (2, 3), (4, 1))]
    lines = load(spark, sf_dir, "supplier").select(k.alias("osm_id"), F.slice(F.array(*vertex), F.lit(1), (k % 5).cast("int")).alias("coords"))
    return graph.segments(graph.usable_lines(lines)).select("osm_id", "place", "ax", "ay", "bx", "by")


QUERIES = {f.__name__: f for f in (tile_alignment, tile_id_parse, label_domain_violations, class_name_lookup, audit_moments, class_histogram, tiles_per_event, modality_bands, class_weights, damage_weights, events_audit, type_eligibility, alignment_findings, event_holdout_split, standard_split, official_split, leakage_check, unknown_ids, balanced_sample, greedy_coverage, validation_events, geometry_plans, centre_crops, path_roundtrip, strict_alignment, required_columns, test_partition_events, pooled_partitions, road_pieces)}

_T = with_sql("tiles")
_COUNTS = """counts AS (
  SELECT CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS label, count(*) AS n
  FROM lineitem GROUP BY 1),
weights AS (SELECT label, n, (1.0 / n) / (SELECT sum(1.0 / n) / 4 FROM counts) AS weight FROM counts)"""
_AUDIT = """audited AS (
  SELECT event_id, string_agg(DISTINCT disaster_type, ';' ORDER BY disaster_type) AS disaster_type, count(*) AS n_tiles,
    bool_and(value >= -900) AS post, string_agg(DISTINCT 'EPSG:326' || lpad(CAST(ordinal % 2 + 32 AS VARCHAR), 2, '0'), ';' ORDER BY 'EPSG:326' || lpad(CAST(ordinal % 2 + 32 AS VARCHAR), 2, '0')) AS crs,
    bool_and(value IS NOT NULL) AS bounds_available
  FROM tiles GROUP BY event_id)"""
_OFFICIAL = """official AS (
  SELECT tile_id, event_id, CASE WHEN ordinal % 10 < 6 THEN 'train' WHEN ordinal % 10 = 7 THEN 'val' ELSE 'test' END AS partition
  FROM tiles WHERE ordinal % 10 < 6 OR ordinal % 10 IN (7, 8))"""
_PLAN = "FROM (SELECT p_partkey AS i, p_size + 60 AS h, p_size + 64 AS w FROM part)"


def _u(name: str) -> str:
    return sql_uniform(f"'{name}:42:0:' || i")


ORACLES = {
    "greedy_coverage": f"""WITH RECURSIVE counts AS (SELECT o_custkey AS tile_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS c0, count(*) FILTER (WHERE o_orderstatus = 'O') AS c1, count(*) FILTER (WHERE o_orderstatus = 'P') AS c2 FROM orders GROUP BY 1),
pick(place, tile_id, t0, t1, t2, chosen) AS (
  SELECT CAST(-1 AS INTEGER), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT * FROM (
    SELECT p.place + 1, c.tile_id, p.t0 + c.c0, p.t1 + c.c1, p.t2 + c.c2, list_append(p.chosen, c.tile_id)
    FROM pick p, counts c WHERE p.place < {COVERAGE_TILES} - 1 AND NOT list_contains(p.chosen, c.tile_id)
    ORDER BY least(p.t0 + c.c0, p.t1 + c.c1, p.t2 + c.c2) DESC, floor((ln(1.0::DOUBLE + p.t0 + c.c0) + ln(1.0::DOUBLE + p.t1 + c.c1) + ln(1.0::DOUBLE + p.t2 + c.c2)) * 1000000) DESC, c.c0 + c.c1 + c.c2 DESC, c.tile_id DESC LIMIT 1))
SELECT place, tile_id FROM pick WHERE place >= 0""",
    "tile_alignment": """SELECT coalesce(o.k, l.k) AS tile_id, CASE WHEN o.k IS NULL THEN 'pre' ELSE 'post' END AS missing
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k
WHERE o.k IS NULL OR l.k IS NULL""",
    "tile_id_parse": _T + """
SELECT tile_id, regexp_extract(tile_id, '^(.*)_([0-9]+)$', 1) AS event, split_part(regexp_extract(tile_id, '^(.*)_([0-9]+)$', 1), '-', -1) AS disaster,
  CAST(regexp_extract(tile_id, '^(.*)_([0-9]+)$', 2) AS BIGINT) AS number, true AS valid FROM tiles""",
    "label_domain_violations": "SELECT quality + 2 * toxic AS label, count(*) AS n_rows FROM labels WHERE quality + 2 * toxic NOT IN (0, 1, 2, 255) GROUP BY 1",
    "class_name_lookup": """SELECT doc_id, label, CASE label WHEN 0 THEN 'background' WHEN 1 THEN 'intact' WHEN 2 THEN 'damaged' WHEN 3 THEN 'destroyed' END AS class_name
FROM (SELECT doc_id, quality + 2 * toxic + CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END AS label FROM labels)""",
    "audit_moments": """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS min, round(max(value), 4) AS max,
  round(sum(value) / count(*), 4) AS mean, round(sqrt(greatest(sum(value * value) / count(*) - (sum(value) / count(*)) * (sum(value) / count(*)), 1e-12)), 4) AS std
FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "class_histogram": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "tiles_per_event": _T + " SELECT event_id, count(*) AS n FROM tiles GROUP BY 1",
    "modality_bands": "SELECT p_type AS modality, p_size % 4 AS band, count(*) AS n FROM part GROUP BY 1, 2",
    "class_weights": f"WITH {_COUNTS} SELECT label, n, round(weight, 6) AS weight FROM weights",
    "damage_weights": f"WITH {_COUNTS} SELECT label, round(weight / (SELECT avg(weight) FROM weights WHERE label > 0), 6) AS weight FROM weights WHERE label > 0",
    "events_audit": f"{_T}, {_AUDIT} SELECT * FROM audited",
    "type_eligibility": f"""{_T}, {_AUDIT}
SELECT disaster_type, count(*) AS n_events, (SELECT count(*) FROM audited) - count(*) AS other_events,
  (SELECT count(*) FROM audited) - count(*) >= 2 AS leave_one_type_out_eligible,
  CASE WHEN (SELECT count(*) FROM audited) - count(*) >= 2 THEN 'two or more events of other types remain for training and validation'
    ELSE 'fewer than two events of other types remain' END AS reason
FROM audited GROUP BY disaster_type""",
    "alignment_findings": f"""{_T}
SELECT tile_id, 'shape' AS what, 'error' AS severity FROM tiles WHERE ordinal % 50 = 0
UNION ALL SELECT tile_id, 'crs', 'error' FROM tiles WHERE ordinal % 70 = 0
UNION ALL SELECT tile_id, 'bounds', 'warning' FROM tiles WHERE ordinal % 30 = 0""",
    "strict_alignment": f"""{_T}
SELECT tile_id, 'size' AS what FROM tiles WHERE ordinal % 50 = 0
UNION ALL SELECT tile_id, 'crs' FROM tiles WHERE ordinal % 80 = 0 OR ordinal % 70 = 0
UNION ALL SELECT tile_id, 'transform' FROM tiles WHERE ordinal % 30 = 0
UNION ALL SELECT tile_id, 'bands' FROM tiles WHERE ordinal % 90 = 0""",
    "required_columns": """SELECT 's_suppkey' AS column, true AS present, count(*) AS n_values FROM supplier
UNION ALL SELECT 'mask', true, count(*) FILTER (WHERE s_suppkey % 4 = 0) FROM supplier UNION ALL SELECT 'geometry', false, 0""",
    "test_partition_events": f"""{_T}, {_OFFICIAL}, held AS (SELECT DISTINCT event_id FROM official WHERE partition = 'test'),
asked AS (SELECT DISTINCT lower(n_name) AS event_id FROM nation WHERE n_nationkey % 3 = 0)
SELECT event_id, 'unexpected' AS problem FROM held WHERE event_id NOT IN (SELECT event_id FROM asked)
UNION ALL SELECT event_id, 'missing' FROM asked WHERE event_id NOT IN (SELECT event_id FROM held)""",
    "pooled_partitions": f"""{_T}, {_OFFICIAL} SELECT event_id, sum(CASE partition WHEN 'val' THEN 2 ELSE 1 END)::BIGINT AS n_rows, count(DISTINCT tile_id) AS n_tiles
FROM official WHERE partition IN ('val', 'test') GROUP BY 1""",
    "road_pieces": """WITH v AS (SELECT s_suppkey AS k, unnest([0, 1, 2, 3]) AS place FROM supplier),
p AS (SELECT k, place, CAST(k * [1, 2, 2, 4][place + 1] % 7 AS DOUBLE) AS x, CAST(k * [1, 3, 3, 1][place + 1] % 5 AS DOUBLE) AS y FROM v WHERE place < k % 5)
SELECT a.k AS osm_id, a.place, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM p a JOIN p b ON a.k = b.k AND b.place = a.place + 1 WHERE a.x <> b.x OR a.y <> b.y""",
    "event_holdout_split": f"""{_T}, named AS (SELECT DISTINCT event_id FROM tiles ORDER BY event_id DESC LIMIT 2)
SELECT tile_id, event_id, CASE WHEN event_id = (SELECT max(event_id) FROM named) THEN 'test' WHEN event_id = (SELECT min(event_id) FROM named) THEN 'val' ELSE 'train' END AS partition FROM tiles""",
    "standard_split": f"""{_T}, ordered AS (
  SELECT tile_id, event_id, row_number() OVER (PARTITION BY event_id ORDER BY md5('42:' || tile_id), tile_id) AS r, count(*) OVER (PARTITION BY event_id) AS n FROM tiles),
sized AS (SELECT *, CASE WHEN n < 3 THEN 1 ELSE least(n - 2, greatest(1, CAST(round_even(n * 0.7, 0) AS BIGINT))) END AS a FROM ordered),
cut AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE least(n - a - 1, greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT))) END AS b FROM sized)
SELECT tile_id, event_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS partition FROM cut""",
    "official_split": f"{_T}, {_OFFICIAL} SELECT * FROM official",
    "leakage_check": f"""{_T}, {_OFFICIAL} SELECT event_id, string_agg(DISTINCT partition, ',' ORDER BY partition) AS partitions FROM official GROUP BY 1 HAVING count(DISTINCT partition) > 1""",
    "unknown_ids": """SELECT DISTINCT l_partkey + CASE WHEN l_suppkey % 9 = 0 THEN 1000000 ELSE 0 END AS id FROM lineitem
WHERE l_partkey + CASE WHEN l_suppkey % 9 = 0 THEN 1000000 ELSE 0 END NOT IN (SELECT p_partkey FROM part)""",
    "balanced_sample": f"""{_T}, e AS (SELECT event_id, count(*) AS n, row_number() OVER (ORDER BY event_id) - 1 AS e FROM tiles GROUP BY event_id),
places AS (SELECT tile_id, event_id, row_number() OVER (PARTITION BY event_id ORDER BY md5('42:' || tile_id), tile_id) AS place FROM tiles),
draws AS (SELECT i AS draw, CAST(floor({sql_uniform("'event42:' || i")} * (SELECT count(*) FROM e)) AS BIGINT) AS e, {sql_uniform("'tile42:' || i")} AS u FROM range({SAMPLE_DRAWS}) t(i))
SELECT draw, e.event_id, tile_id FROM draws JOIN e USING (e) JOIN places ON places.event_id = e.event_id AND place = CAST(floor(u * n) AS BIGINT) + 1""",
    "validation_events": f"""{_T} SELECT min(event_id) AS first_event, max(event_id) AS last_event FROM tiles WHERE event_id <> (SELECT max(event_id) FROM tiles)""",
    "geometry_plans": f"""SELECT i, h, w, {_u('h')} < 0.5 AS hflip, {_u('v')} < 0.5 AS vflip, CAST(floor({_u('q')} * 4) AS INTEGER) AS quarter_turns,
  CAST(floor({_u('t')} * (greatest(h - {CROP}, 0) + 1)) AS INTEGER) AS top, CAST(floor({_u('l')} * (greatest(w - {CROP}, 0) + 1)) AS INTEGER) AS "left" {_PLAN}""",
    "centre_crops": f"""SELECT i, CAST(greatest(h - {CROP}, 0) // 2 AS INTEGER) AS top, CAST(greatest(w - {CROP}, 0) // 2 AS INTEGER) AS "left" {_PLAN}""",
    "path_roundtrip": f"{_T} SELECT tile_id, 'pre-event/' || tile_id || '_pre.tif' AS relative, '/mnt/copy/pre-event/' || tile_id || '_pre.tif' AS absolute FROM tiles",
}
