"""Queries on geometry tables and polygons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import labelling, spatial
from cairnfield.operators.iterate import dealt, kept
from cairnfield.plans.analogues import buildings, mask, roads, with_sql
from cairnfield.plans.priority_queries import _CC
from cairnfield.sources import geometry
from cairnfield.streaming.metrics import shared_folder

CRS = "EPSG:32632"
#: The box of the box query.
WITHIN = (2_000.0, 3_000.0, 4_000.0, 4_500.0)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as points, lines, boxes with a hole, or two boxes, by their number."""
    x, y, k = F.col("x"), F.col("y"), F.col("building_id") % 4
    at = lambda dx, dy: geometry.vertex(x + dx, y + dy)
    ring = lambda a, b: F.array(at(a, a), at(b, a), at(b, b), at(a, b), at(a, a))
    shape = F.when(k == 0, geometry.point(x, y)).when(k == 1, geometry.line(F.array(at(0, 0), at(30, 0), at(30, 40))))
    shape = shape.when(k == 2, geometry.polygon(F.array(ring(0, 20), ring(5, 10)))).otherwise(geometry.polygons(F.array(F.array(ring(0, 10)), F.array(ring(20, 25)))))
    return buildings(spark, sf_dir).select("building_id", shape.alias("geometry"))


def _table(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark)
    geometry.write_geometries(_shapes(spark, sf_dir), folder, CRS)
    return folder


def geometry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes written in binary form and read back: kind, vertices, area and box."""
    rows = geometry.read_geometries(spark, _table(spark, sf_dir))
    g = F.col("geometry")
    n = F.size(F.flatten(F.flatten(g["parts"])))
    return rows.select("building_id", g["kind"].alias("kind"), n.alias("n"), F.round(geometry.area(g), 3).alias("area"), *[F.round(F.col(f"bbox.{c}"), 4).alias(c) for c in geometry.BOX], F.lit(geometry.require_same_crs(rows)).alias("crs"))


def geometry_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes whose box meets a window, from the row groups that may hold any."""
    rows = geometry.read_geometries(spark, _table(spark, sf_dir), WITHIN)
    return rows.select("building_id", F.col("geometry.kind").alias("kind"))


def component_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the components of the label masks: parts, holes, corners, area and box."""
    rows = labelling.polygonise(mask(spark, sf_dir), 40, affine=(0.0, 10.0, 0.0, 10.0))
    g = F.col("geometry")
    n = F.size(F.flatten(F.flatten(g["parts"]))).cast("long")
    box = geometry.bbox(g)
    return rows.select("tile_id", "component", "pixel_count", F.size(g["parts"]).cast("long").alias("n_parts"), "n_holes", n.alias("n_vertices"), F.round(geometry.area(g), 3).alias("area"), *[box[c].alias(c) for c in geometry.BOX])


def component_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside of each component, and the component of the pixel that it lies in."""
    pixels = mask(spark, sf_dir)
    shapes = labelling.polygonise(pixels, 40).select("tile_id", "component", geometry.interior_point(F.col("geometry")).alias("p"))
    at = shapes.select("tile_id", "component", F.floor("p.y").cast("int").alias("row"), F.floor("p.x").cast("int").alias("col"))
    own = labelling.connected_components(pixels, width=40).withColumnRenamed("component", "found")
    return at.join(dealt(own), ["tile_id", "row", "col"], "left").select("tile_id", "component", F.coalesce("found", F.lit(-1)).alias("found"))


def road_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected destroyed buildings whose outline, an angle with a court in it, comes within RADIUS of each road."""
    x, y = F.col("x"), F.col("y")
    ring = lambda places: F.array(*[geometry.vertex(x + dx, y + dy) for dx, dy in places])
    places = kept(buildings(spark, sf_dir).select("building_id", "x", "y", "p_destroyed"))  # every corner refers to the drawn place
    shapes = places.select("building_id", "p_destroyed", geometry.polygon(F.array(*[ring(r) for r in OUTLINE])).alias("geometry"))
    found = spatial.near_polygon_sums(shapes, roads(spark, sf_dir), RADIUS, "road_id", "p_destroyed")
    return found.select("road_id", "n", F.round("total", 6).alias("destroyed"))


#: Distance of the road query, and the rings of its buildings.
RADIUS = 40.0
OUTLINE = (((0, 0), (300, 0), (300, 120), (120, 120), (120, 260), (0, 260), (0, 0)), ((20, 20), (20, 100), (110, 100), (110, 20), (20, 20)))

QUERIES = {f.__name__: f for f in (road_polygons, geometry_roundtrip, geometry_box, component_polygons, component_points)}

_SHAPES = f"""{with_sql('buildings')}, shapes AS (
  SELECT building_id, x, y, CAST([1, 2, 3, 6][building_id % 4 + 1] AS INTEGER) AS kind, CAST([1, 3, 10, 10][building_id % 4 + 1] AS INTEGER) AS n,
    [0.0, 0.0, 375.0, 125.0][building_id % 4 + 1]::DOUBLE AS area, [0, 30, 20, 25][building_id % 4 + 1] AS w, [0, 40, 20, 25][building_id % 4 + 1] AS h FROM buildings)"""
# Parts share sides. A part's holes follow from its corners, sides and pixels (Euler); its corners from the pixels around each.
_PARTS = _CC + """,
n4 AS (SELECT a.tile_id, a.pixel AS f, b.pixel AS t FROM px a JOIN px b ON a.tile_id = b.tile_id AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
walk4(tile_id, pixel, label) USING KEY (tile_id, pixel) AS (SELECT tile_id, pixel, pixel FROM px UNION (
  SELECT n4.tile_id, n4.t, min(w.label) FROM walk4 w JOIN n4 ON n4.tile_id = w.tile_id AND n4.f = w.pixel JOIN recurring.walk4 AS old ON old.tile_id = n4.tile_id AND old.pixel = n4.t WHERE w.label < old.label GROUP BY n4.tile_id, n4.t)),
c4 AS (SELECT cc.*, w.label AS part FROM cc JOIN walk4 w ON w.tile_id = cc.tile_id AND w.pixel = "row" * 40 + col),
corners AS (SELECT tile_id, component, part, "row" + dr AS vr, col + dc AS vc, count(*) AS n, count(DISTINCT "row") + count(DISTINCT col) AS spread FROM c4, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc) GROUP BY 1, 2, 3, 4, 5),
sides AS (SELECT DISTINCT tile_id, part, 2 * "row" + 1 + dr AS sr, 2 * col + 1 + dc AS sc FROM c4, (VALUES (-1, 0), (0, 1), (1, 0), (0, -1)) d(dr, dc)),
holes AS (
  SELECT p.tile_id, p.component, p.part, 1 - (v.n - s.n + p.n) AS holes, v.turns
  FROM (SELECT tile_id, component, part, count(*) AS n FROM c4 GROUP BY 1, 2, 3) p
  JOIN (SELECT tile_id, part, count(*) AS n, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND spread = 4 THEN 2 ELSE 0 END) AS turns FROM corners GROUP BY 1, 2) v ON v.tile_id = p.tile_id AND v.part = p.part
  JOIN (SELECT tile_id, part, count(*) AS n FROM sides GROUP BY 1, 2) s ON s.tile_id = p.tile_id AND s.part = p.part)"""
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for ring in OUTLINE for a, b in zip(ring, ring[1:]))


def _d2(px: str, py: str, s: str) -> str:
    ax, ay, bx, by = (f"{s}{c}" for c in ("ax", "ay", "bx", "by"))
    t = f"least(greatest(coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0), 0), 0), 1)"
    return f"(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2))"


def _turn(px: str, py: str, s: str) -> str:
    return f"sign(({s}bx - {s}ax) * ({py} - {s}ay) - ({s}by - {s}ay) * ({px} - {s}ax))"


_ROAD_POLYGONS = f"""{with_sql('buildings', 'junctions', 'roads')},
ends AS (SELECT road_id, ax AS rax, ay AS ray, bx AS rbx, "by" AS rby FROM roads),
outline(dax, day, dbx, dby) AS (VALUES {_EDGES}),
sides AS (SELECT building_id, x + dax AS eax, y + day AS eay, x + dbx AS ebx, y + dby AS eby FROM buildings, outline),
pairs AS (
  SELECT DISTINCT building_id, road_id FROM sides, ends
  WHERE least(rax, rbx) - {RADIUS} <= greatest(eax, ebx) AND greatest(rax, rbx) + {RADIUS} >= least(eax, ebx) AND least(ray, rby) - {RADIUS} <= greatest(eay, eby) AND greatest(ray, rby) + {RADIUS} >= least(eay, eby)
    AND (least({_d2('eax', 'eay', 'r')}, {_d2('ebx', 'eby', 'r')}, {_d2('rax', 'ray', 'e')}, {_d2('rbx', 'rby', 'e')}) <= {RADIUS * RADIUS}
      OR ({_turn('eax', 'eay', 'r')} * {_turn('ebx', 'eby', 'r')} < 0 AND {_turn('rax', 'ray', 'e')} * {_turn('rbx', 'rby', 'e')} < 0))
  UNION
  SELECT building_id, road_id FROM buildings, ends WHERE rax > x AND ray > y AND ((rax < x + 300 AND ray < y + 120) OR (rax < x + 120 AND ray < y + 260)) AND NOT (rax > x + 20 AND rax < x + 110 AND ray > y + 20 AND ray < y + 100))"""
ORACLES = {
    "road_polygons": f"{_ROAD_POLYGONS} SELECT road_id, count(*) AS n, round(sum(p_destroyed), 6) AS destroyed FROM pairs JOIN buildings USING (building_id) GROUP BY 1",
    "component_polygons": f"""{_PARTS}
SELECT c.*, n_parts, n_holes, n_vertices FROM (
  SELECT tile_id, component, count(*) AS pixel_count, count(*) * 100.0::DOUBLE AS area, min(col) * 10.0::DOUBLE AS xmin, min("row") * 10.0::DOUBLE AS ymin, (max(col) + 1) * 10.0::DOUBLE AS xmax, (max("row") + 1) * 10.0::DOUBLE AS ymax FROM cc GROUP BY 1, 2) c
JOIN (SELECT tile_id, component, count(*) AS n_parts, CAST(sum(holes) AS BIGINT) AS n_holes, CAST(sum(turns + 1 + holes) AS BIGINT) AS n_vertices FROM holes GROUP BY 1, 2) h USING (tile_id, component)""",
    "component_points": f"{_CC} SELECT DISTINCT tile_id, component, component AS found FROM cc",
    "geometry_roundtrip": f"{_SHAPES} SELECT building_id, kind, n, area, round(x, 4) AS xmin, round(y, 4) AS ymin, round(x + w, 4) AS xmax, round(y + h, 4) AS ymax, '{CRS}' AS crs FROM shapes",
    "geometry_box": f"{_SHAPES} SELECT building_id, kind FROM shapes WHERE x <= {WITHIN[2]} AND x + w >= {WITHIN[0]} AND y <= {WITHIN[3]} AND y + h >= {WITHIN[1]}",
}
