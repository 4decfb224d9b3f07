"""Queries on the decision grid, the road graph and priorities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators import graph, labelling, priority, simulation, spatial
from cairnfield.operators.iterate import kept
from cairnfield.plans.analogues import CELL, buildings, junctions, load, mask, population, roads, sql_uniform, tiles, with_sql

RADIUS = 125.0
SIMULATIONS, SAMPLES = 500, 1000


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _grid(spark: SparkSession, sf_dir: str):
    b = buildings(spark, sf_dir)
    return b, spatial.lattice(spatial.extent(b), CELL)


def _placed(b: DataFrame, grid) -> DataFrame:
    entropy = C.normalised_entropy(F.array("p_intact", "p_damaged", "p_destroyed"), 3)
    return b.withColumns({"cell": spatial.cell_of(F.col("x"), F.col("y"), grid, CELL), "predictive_entropy": entropy})


def decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.decision_grid(spark, _grid(spark, sf_dir)[1], CELL)


def building_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, grid = _grid(spark, sf_dir)
    return _placed(b, grid).select("building_id", F.coalesce("cell", F.lit(-1)).alias("cell"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, grid = _grid(spark, sf_dir)
    cells = spatial.cell_aggregates(spatial.decision_grid(spark, grid, CELL), _placed(b, grid))
    people = population(spark, sf_dir)
    people = people.withColumn("cell", spatial.cell_of(F.col("x"), F.col("y"), grid, CELL, edges=True))
    return spatial.zonal_sum(cells, people)


def cell_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return c.select("cell_id", "number_buildings", *_r("expected_damaged_buildings", "expected_destroyed_buildings", "mean_expected_severity", "mean_model_entropy"))


def zonal_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("cell_id", *_r("population_total"))


def _scorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with an accessibility penalty (drawn by cell) and a hazard that a fifth of them lack."""
    c = _cells(spark, sf_dir).withColumn("accessibility_penalty", C.uniform("acc", F.col("cell")))
    c = c.withColumn("hazard", F.when(F.col("cell") % 5 != 0, C.uniform("hazard", F.col("cell"))))
    return kept(c)  # quantiles and rows are taken from the same cells


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priority.components(_scorable(spark, sf_dir))
    return rows.select("cell", *_r("damage_score", "population_score", "accessibility_score"))


def exposure_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priority.components(_scorable(spark, sf_dir))
    return rows.select("cell", F.round(F.col("population_total") * F.col("damage_score"), 6).alias("population_damage_exposure"))


def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priority.prioritise(_scorable(spark, sf_dir))
    return rows.select("cell_id", "priority_rank", *_r("priority_score"))


def priority_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: buildings to cells to scores, ranks and bands."""
    rows = priority.prioritise(_scorable(spark, sf_dir))
    return rows.select("cell_id", "number_buildings", *_r("damage_score", "population_score", "accessibility_score", "priority_score"), "priority_rank", "relative_priority_band", "hazard_available")


def priority_with_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priority.prioritise(_scorable(spark, sf_dir), hazard="hazard")
    return rows.select("cell_id", *_r("hazard_score", "priority_score"), "priority_rank", "relative_priority_band")


def hazard_renormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each cell's components, which depend on whether the cell has a hazard."""
    rows = _scorable(spark, sf_dir).select("cell", (F.col("cell") % 3 > 0).alias("hazard_available"))
    of = {h: F.array(*[F.struct(F.lit(n).alias("component"), F.lit(round(w, 9)).alias("weight")) for n, w in priority.available_weights(hazard=h).items()]) for h in (False, True)}
    each = F.explode(F.when(F.col("hazard_available"), of[True]).otherwise(of[False])).alias("w")
    return rows.select("cell", "hazard_available", each).select("cell", "hazard_available", "w.component", "w.weight")


def app_reweighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priority.components(_scorable(spark, sf_dir)).withColumn("hazard_score", F.col("hazard") * 1.5 - 0.2)
    out = priority.reweighted(rows, {"damage": 1, "population": 1, "accessibility": 1, "hazard": 2}, True)
    return out.select("cell_id", *_r("hazard_score", "priority_score"), "relative_priority_band")


def band_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priority.prioritise(_scorable(spark, sf_dir))
    return rows.groupBy("relative_priority_band").agg(F.count("*").alias("n_cells"), F.round(F.sum("population_total"), 4).alias("population"), F.round(F.avg("mean_expected_severity"), 6).alias("severity"), F.round(F.max("priority_score"), 6).alias("most"))


def monte_carlo_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, grid = _grid(spark, sf_dir)
    cells = priority.components(_scorable(spark, sf_dir))
    u = simulation.uncertainty(cells, _placed(b, grid), SIMULATIONS)
    return u.select("cell", *_r(*[c for c in u.columns if c != "cell"]))


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    rows = priority.prioritise(_scorable(spark, sf_dir))
    grid = _grid(spark, sf_dir)[1]
    weights = priority.weight_draws(spark, SAMPLES)
    return priority.sensitivity_draws(rows, weights), weights, grid[2] * grid[3]


def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, weights, n = _sampled(spark, sf_dir)
    rows = priority.sensitivity(draws, n).join(weights, "sample")
    return rows.select("sample", *_r("spearman_rank_correlation", "top_decile_overlap", "weight_damage", "weight_population", "weight_accessibility"))


def weight_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, _, n = _sampled(spark, sf_dir)
    return priority.stability(draws, n).select("cell", *_r("weight_rank_variance", "weight_prob_top_10_percent"))


def sensitivity_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, _, n = _sampled(spark, sf_dir)
    rows = priority.sensitivity(draws, n)
    return rows.agg(F.round(F.median("spearman_rank_correlation"), 6).alias("spearman"), F.round(F.median("top_decile_overlap"), 6).alias("overlap"))


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.road_risk(roads(spark, sf_dir), buildings(spark, sf_dir), RADIUS)


def road_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select(F.concat(F.lit("road_"), F.lpad(F.col("road_id").cast("string"), 7, "0")).alias("road_id"), *_r("length", "density", "estimated_risk"))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.edges(_risk(spark, sf_dir))
    return e.select("edge_id", *_r("normal_cost", "risk_cost", "estimated_risk"))


def _graph(spark: SparkSession, sf_dir: str):
    """Edges with text nodes, the nodes with positions, and the facilities' nodes."""
    def name(c: str):
        return F.concat_ws(",", F.format_string("%.3f", f"{c}.x"), F.format_string("%.3f", f"{c}.y"))

    raw = graph.edges(_risk(spark, sf_dir))
    e = raw.withColumns({"a": name("u"), "b": name("v")})
    nodes = e.select(F.col("a").alias("node"), "u.*").union(e.select("b", "v.*")).distinct()
    places = junctions(spark, sf_dir).where("facility").select(F.col("node").alias("facility"), "x", "y")
    return e, nodes, spatial.nearest(places, nodes, "facility")


def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, _ = _graph(spark, sf_dir)
    cells = spatial.decision_grid(spark, _grid(spark, sf_dir)[1], CELL)
    centres = cells.select("cell", (F.col("minx") + CELL / 2).alias("x"), (F.col("miny") + CELL / 2).alias("y"))
    return spatial.nearest(centres, nodes, "cell").select("cell", "node", F.round("d2", 4).alias("d2"))


def facility_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, sources = _graph(spark, sf_dir)
    base = graph.distances(e, sources, "normal_cost", "a", "b").select("node", F.col("cost").alias("normal_cost"))
    risk = graph.distances(e, sources, "risk_cost", "a", "b").select("node", F.col("cost").alias("risk_cost"))
    return base.join(risk, "node").select("node", *_r("normal_cost", "risk_cost"))


def accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, nodes, sources = _graph(spark, sf_dir)
    cells = spatial.decision_grid(spark, _grid(spark, sf_dir)[1], CELL)
    centres = cells.select("cell", (F.col("minx") + CELL / 2).alias("x"), (F.col("miny") + CELL / 2).alias("y"))
    at = spatial.nearest(centres, nodes, "cell").select("cell", "node")
    rows = graph.accessibility(at, graph.distances(e, sources, "normal_cost", "a", "b"), graph.distances(e, sources, "risk_cost", "a", "b"))
    costs = [F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("normal_facility_cost_m", "risk_adjusted_facility_cost_m")]
    return rows.select("cell", *costs, *_r("accessibility_penalty"), "accessibility_status")


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.connected_components(mask(spark, sf_dir), width=40)


def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = labelling.component_boxes(labelling.connected_components(mask(spark, sf_dir), width=40), 10.0)
    return boxes.select("tile_id", "component", "pixel_count", *_r("minx", "miny", "maxx", "maxy", "x", "y"))


def component_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon sets of components, as boxes."""
    runs = labelling.component_runs(labelling.connected_components(mask(spark, sf_dir), width=40), 10.0)
    return runs.select("tile_id", "component", *_r("minx", "miny", "maxx", "maxy"))


def display_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.stretch(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return rows.select("event_id", *_r("stretched"))


def mosaic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("x"), (F.col("o_orderkey") % 50).alias("y"), F.col("o_orderkey").alias("tile"), F.lit("EPSG:32632").alias("crs"), F.col("o_totalprice").alias("value"))
    return spatial.mosaic(o, "tile")


def raster_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of events in the three modes: as they are, scaled, and standardised."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("px"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where("s > 0")
    first = [C.normalised_pixels(F.col("px"), mode, F.col("m"), F.col("s"))[0] for mode in ("none", "scale_uint", "zscore")]
    return e.select("user_id", *[F.round(v, 6).alias(n) for v, n in zip(first, ("raw", "scaled", "standard"), strict=True)])


def utm_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones and projected positions of points spread over the globe (rows only: the series is tested against known points)."""
    lon, lat = C.uniform("lon", F.col("s_suppkey")) * 360 - 180, C.uniform("lat", F.col("s_suppkey")) * 160 - 80
    p = load(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"))
    p = p.withColumn("zone", C.utm_zone(F.col("lon")))
    x, y = C.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return p.select("s_suppkey", "zone", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


QUERIES = {f.__name__: f for f in (decision_grid, building_cells, cell_aggregates, zonal_population, robust_scale, exposure_proxy, priority_score, priority_bands, priority_with_hazard, hazard_renormalise, app_reweighting, band_report, monte_carlo_priority, weight_sensitivity, weight_stability, sensitivity_medians, road_risk, road_edges, nearest_node, facility_distance, accessibility, connected_components, component_boxes, component_runs, display_stretch, mosaic_first, raster_normalise, utm_positions)}

_G = with_sql("buildings", "population") + f""",
e AS (SELECT floor(min(x) / {CELL}) * {CELL} AS x0, floor(min(y) / {CELL}) * {CELL} AS y0, max(x) AS x1, max(y) AS y1 FROM buildings),
g AS (SELECT x0, y0, CAST(ceil((x1 + {CELL} - x0) / {CELL}) - 1 AS BIGINT) AS nx, CAST(ceil((y1 + {CELL} - y0) / {CELL}) - 1 AS BIGINT) AS ny FROM e),
grid AS (SELECT i AS cell, 'cell_' || lpad(CAST(i AS VARCHAR), 6, '0') AS cell_id, i // ny AS ix, i % ny AS iy, x0 + (i // ny) * {CELL} AS minx, y0 + (i % ny) * {CELL} AS miny FROM g, range((SELECT nx * ny FROM g)) t(i)),
placed AS (SELECT b.*, CASE WHEN (x - x0) / {CELL} = floor((x - x0) / {CELL}) OR (y - y0) / {CELL} = floor((y - y0) / {CELL}) THEN NULL
  ELSE CAST(floor((x - x0) / {CELL}) * ny + floor((y - y0) / {CELL}) AS BIGINT) END AS cell FROM buildings b, g),
agg AS (SELECT cell, count(*) AS nb, sum(p_damaged) AS da, sum(p_destroyed) AS de, avg(p_damaged + 2 * p_destroyed) AS sev,
  avg(-(p_intact * ln(greatest(p_intact, 1e-12)) + p_damaged * ln(greatest(p_damaged, 1e-12)) + p_destroyed * ln(greatest(p_destroyed, 1e-12))) / ln(3)) AS ent FROM placed WHERE cell IS NOT NULL GROUP BY 1),
pop AS (SELECT CAST(floor((x - x0) / {CELL}) * ny + floor((y - y0) / {CELL}) AS BIGINT) AS cell, sum(greatest(value, 0)) AS total FROM population, g
  WHERE floor((x - x0) / {CELL}) BETWEEN 0 AND nx - 1 AND floor((y - y0) / {CELL}) BETWEEN 0 AND ny - 1 GROUP BY 1),
cells AS (SELECT grid.*, coalesce(nb, 0) AS nb, coalesce(da, 0) AS da, coalesce(de, 0) AS de, coalesce(sev, 0) AS sev, coalesce(ent, 0) AS ent, coalesce(total, 0) AS total
  FROM grid LEFT JOIN agg USING (cell) LEFT JOIN pop USING (cell))"""


def _robust(raw: str, source: str) -> str:
    lo, hi = (f"(SELECT quantile_cont({raw}, {q}) FROM {source})" for q in (0.02, 0.98))
    return f"CASE WHEN {hi} <= {lo} THEN 0.0 ELSE least(greatest(({raw} - {lo}) / ({hi} - {lo}), 0.0), 1.0) END"


_S = _G + f""",
raws AS (SELECT *, da + 2.0 * de AS raw_d, ln(1 + greatest(total, 0)) AS raw_p, {sql_uniform("'acc:' || cell")} AS s_a, CASE WHEN cell % 5 <> 0 THEN {sql_uniform("'hazard:' || cell")} END AS hz FROM cells),
scores AS (SELECT *, {_robust('raw_d', 'raws')} AS s_d, {_robust('raw_p', 'raws')} AS s_p, {_robust('coalesce(hz, 0)', 'raws')} AS s_h FROM raws)"""
_W = priority.available_weights()
_WH = priority.available_weights(hazard=True)


def _ranked_sql(score: str, name: str, source: str = "scores") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, cell) AS r,
  CASE WHEN round(score, 12) >= round((SELECT quantile_cont(round(score, 12), 0.9) FROM {name}_0), 12) THEN 'CRITICAL' WHEN round(score, 12) >= round((SELECT quantile_cont(round(score, 12), 0.75) FROM {name}_0), 12) THEN 'HIGH'
    WHEN round(score, 12) >= round((SELECT quantile_cont(round(score, 12), 0.5) FROM {name}_0), 12) THEN 'MODERATE' ELSE 'LOW' END AS band FROM {name}_0)"""


def _scored_sql(weights: dict[str, float], name: str) -> str:
    short = {"damage": "s_d", "population": "s_p", "accessibility": "s_a", "hazard": "s_h"}
    score = " + ".join(f"{w!r}::DOUBLE * {short[n]}" for n, w in weights.items())
    return f"{name}_0 AS (SELECT *, {score} AS score FROM scores),\n" + _ranked_sql("score", name)


_P = _S + ",\n" + _scored_sql(_W, "pr")
_TOP = "(SELECT greatest(1, CAST(ceil(0.1 * count(*)) AS BIGINT)) FROM grid)"
_MC = _S + f""",
drawn AS (SELECT cell, sim, sum(CASE WHEN u > c2 THEN 2.0::DOUBLE WHEN u > c1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS raw FROM (
  SELECT cell, i AS sim, p_intact / (p_intact + p_damaged + p_destroyed) AS c1, p_intact / (p_intact + p_damaged + p_destroyed) + p_damaged / (p_intact + p_damaged + p_destroyed) AS c2,
    {sql_uniform("'mc42:' || building_id || ':' || i")} AS u FROM placed, range({SIMULATIONS}) t(i) WHERE cell IS NOT NULL) GROUP BY 1, 2),
f AS (SELECT s.cell, i AS sim, s_p, s_a, coalesce(raw, 0) AS raw FROM scores s CROSS JOIN range({SIMULATIONS}) t(i) LEFT JOIN drawn d ON d.cell = s.cell AND d.sim = i),
q AS (SELECT sim, quantile_cont(raw, 0.02) AS lo, quantile_cont(raw, 0.98) AS hi FROM f GROUP BY 1),
sc AS (SELECT sim, cell, {_W['damage']!r}::DOUBLE * CASE WHEN hi <= lo THEN 0 ELSE least(greatest((raw - lo) / (hi - lo), 0), 1) END + {_W['population']!r}::DOUBLE * s_p + {_W['accessibility']!r}::DOUBLE * s_a AS score FROM f JOIN q USING (sim)),
dr AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY round(score, 12) DESC, cell) AS r FROM sc)"""
_RANGE = priority.RANGES
_SE = _P + ",\nwd0 AS (SELECT i AS sample, " + ", ".join(f"{lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * " + sql_uniform(f"'weight43:{n}:' || i") + f" AS w_{n}" for n, (lo, hi) in _RANGE.items() if n != "hazard") + f""" FROM range({SAMPLES}) t(i)),
wd AS (SELECT sample, w_damage / (w_damage + w_population + w_accessibility) AS a, w_population / (w_damage + w_population + w_accessibility) AS b, w_accessibility / (w_damage + w_population + w_accessibility) AS c FROM wd0),
sd AS (SELECT sample, cell, pr.r AS dr, a * s_d + b * s_p + c * s_a AS score FROM pr, wd),
sr AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(score, 12) DESC, cell) AS r FROM sd),
ss AS (SELECT sample, corr(dr, r) AS rho, sum(CASE WHEN r <= {_TOP} AND dr <= {_TOP} THEN 1.0 ELSE 0.0 END) / {_TOP} AS overlap FROM sr GROUP BY 1)"""
_DIST = """sqrt((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (y - (ay + t * ("by" - ay))) * (y - (ay + t * ("by" - ay))))"""
_R = _G + ",\n" + with_sql("junctions", "roads").removeprefix("WITH RECURSIVE ") + f""",
rl AS (SELECT *, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS len FROM roads),
near AS (SELECT road_id, sum(p_destroyed) AS d FROM (SELECT road_id, p_destroyed, x, y, ax, ay, bx, "by", least(greatest(((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / (len * len), 0), 1) AS t FROM rl, buildings WHERE len > 0) WHERE {_DIST} <= {RADIUS} GROUP BY 1),
dens AS (SELECT rl.*, coalesce(d, 0) / greatest(len * {2 * RADIUS / 1_000_000!r}, 1e-6) AS density FROM rl LEFT JOIN near USING (road_id) WHERE len > 0),
risk AS (SELECT *, {_robust('density', 'dens')} AS risk FROM dens),
eg AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM risk),
ed AS (SELECT a, b, road_id AS edge_id, len AS w, len * (1 + 4.0 * risk) AS rw, risk FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len, road_id) AS k FROM eg) WHERE k = 1),
nd AS (SELECT DISTINCT node, x, y, printf('%.3f', x) || ',' || printf('%.3f', y) AS name FROM junctions WHERE node IN (SELECT a FROM ed UNION SELECT b FROM ed)),
fa AS (SELECT DISTINCT node FROM (SELECT nd.node, row_number() OVER (PARTITION BY j.node ORDER BY (nd.x - j.x) * (nd.x - j.x) + (nd.y - j.y) * (nd.y - j.y), nd.x, nd.y) AS k FROM junctions j, nd WHERE j.facility) WHERE k = 1),
nn AS (SELECT cell, node, name, d2 FROM (SELECT cell, node, name, d2, row_number() OVER (PARTITION BY cell ORDER BY d2, x, y) AS k FROM (
  SELECT cell, nd.node, name, nd.x, nd.y, (minx + {CELL / 2} - nd.x) * (minx + {CELL / 2} - nd.x) + (miny + {CELL / 2} - nd.y) * (miny + {CELL / 2} - nd.y) AS d2 FROM grid, nd)) WHERE k = 1),
both_ AS (SELECT a, b, w, rw FROM ed UNION ALL SELECT b, a, w, rw FROM ed)"""


def _paths(name: str, w: str) -> str:
    return f"""{name}(node, cost) USING KEY (node) AS (SELECT node, 0.0::DOUBLE FROM fa UNION (
  SELECT e.b, min({name}.cost + e.{w}) FROM {name} JOIN both_ e ON {name}.node = e.a LEFT JOIN recurring.{name} AS old ON old.node = e.b WHERE old.cost IS NULL OR {name}.cost + e.{w} < old.cost GROUP BY e.b))"""


_PATHS = f"{_R},\n{_paths('dn', 'w')},\n{_paths('dr', 'rw')}"
_CC = with_sql("mask") + """,
px AS (SELECT tile_id, "row", col, "row" * 40 + col AS pixel FROM mask),
ne AS (SELECT a.tile_id, a.pixel AS f, b.pixel AS t FROM px a JOIN px b ON a.tile_id = b.tile_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND a.pixel <> b.pixel),
walk(tile_id, pixel, label) USING KEY (tile_id, pixel) AS (SELECT tile_id, pixel, pixel FROM px UNION (
  SELECT ne.tile_id, ne.t, min(w.label) FROM walk w JOIN ne ON ne.tile_id = w.tile_id AND ne.f = w.pixel JOIN recurring.walk AS old ON old.tile_id = ne.tile_id AND old.pixel = ne.t WHERE w.label < old.label GROUP BY ne.tile_id, ne.t)),
cc AS (SELECT px.tile_id, "row", col, CAST(label AS BIGINT) AS component FROM px JOIN walk USING (tile_id, pixel))"""

ORACLES = {
    "decision_grid": f"{_G} SELECT cell, cell_id, ix, iy, minx, miny, minx + {CELL} AS maxx, miny + {CELL} AS maxy FROM grid",
    "building_cells": f"{_G} SELECT building_id, coalesce(cell, -1) AS cell FROM placed",
    "cell_aggregates": f"{_G} SELECT cell_id, nb AS number_buildings, round(da, 6) AS expected_damaged_buildings, round(de, 6) AS expected_destroyed_buildings, round(sev, 6) AS mean_expected_severity, round(ent, 6) AS mean_model_entropy FROM cells",
    "zonal_population": f"{_G} SELECT cell_id, round(total, 6) AS population_total FROM cells",
    "robust_scale": f"{_S} SELECT cell, round(s_d, 6) AS damage_score, round(s_p, 6) AS population_score, round(s_a, 6) AS accessibility_score FROM scores",
    "exposure_proxy": f"{_S} SELECT cell, round(total * s_d, 6) AS population_damage_exposure FROM scores",
    "priority_score": f"{_P} SELECT cell_id, r AS priority_rank, round(score, 6) AS priority_score FROM pr",
    "priority_bands": f"{_P} SELECT cell_id, nb AS number_buildings, round(s_d, 6) AS damage_score, round(s_p, 6) AS population_score, round(s_a, 6) AS accessibility_score, round(score, 6) AS priority_score, r AS priority_rank, band AS relative_priority_band, false AS hazard_available FROM pr",
    "priority_with_hazard": f"{_S},\n{_scored_sql(_WH, 'ph')} SELECT cell_id, round(s_h, 6) AS hazard_score, round(score, 6) AS priority_score, r AS priority_rank, band AS relative_priority_band FROM ph",
    "hazard_renormalise": f"""{_G}, w(component, w) AS (VALUES ('damage', 0.4::DOUBLE), ('population', 0.3::DOUBLE), ('accessibility', 0.2::DOUBLE), ('hazard', 0.1::DOUBLE))
SELECT cell, cell % 3 > 0 AS hazard_available, component, round(w / sum(w) OVER (PARTITION BY cell), 9) AS weight FROM grid JOIN w ON cell % 3 > 0 OR component <> 'hazard'""",
    "app_reweighting": f"""{_S},
ap_0 AS (SELECT *, least(greatest(coalesce(hz * 1.5 - 0.2, 0), 0), 1) AS h FROM scores), ap_1 AS (SELECT * EXCLUDE (h), h, 0.2::DOUBLE * s_d + 0.2::DOUBLE * s_p + 0.2::DOUBLE * s_a + 0.4::DOUBLE * h AS score FROM ap_0)
SELECT cell_id, round(h, 6) AS hazard_score, round(score, 6) AS priority_score, CASE WHEN round(score, 12) >= round((SELECT quantile_cont(round(score, 12), 0.9) FROM ap_1), 12) THEN 'CRITICAL' WHEN round(score, 12) >= round((SELECT quantile_cont(round(score, 12), 0.75) FROM ap_1), 12) THEN 'HIGH'
  WHEN round(score, 12) >= round((SELECT quantile_cont(round(score, 12), 0.5) FROM ap_1), 12) THEN 'MODERATE' ELSE 'LOW' END AS relative_priority_band FROM ap_1""",
    "band_report": f"{_P} SELECT band AS relative_priority_band, count(*) AS n_cells, round(sum(total), 4) AS population, round(avg(sev), 6) AS severity, round(max(score), 6) AS most FROM pr GROUP BY 1",
    "monte_carlo_priority": f"""{_MC} SELECT cell, round(avg(score), 6) AS priority_mean, round(quantile_cont(score, 0.05), 6) AS priority_p05, round(quantile_cont(score, 0.5), 6) AS priority_p50, round(quantile_cont(score, 0.95), 6) AS priority_p95,
  round(avg(r), 6) AS rank_mean, round(quantile_cont(r::DOUBLE, 0.05), 6) AS rank_p05, round(quantile_cont(r::DOUBLE, 0.95), 6) AS rank_p95, round(avg(CASE WHEN r <= {_TOP} THEN 1.0 ELSE 0.0 END), 6) AS prob_top_10_percent FROM dr GROUP BY 1""",
    "weight_sensitivity": f"{_SE} SELECT sample, round(rho, 6) AS spearman_rank_correlation, round(overlap, 6) AS top_decile_overlap, round(a, 6) AS weight_damage, round(b, 6) AS weight_population, round(c, 6) AS weight_accessibility FROM ss JOIN wd USING (sample)",
    "weight_stability": f"{_SE} SELECT cell, round(var_pop(r), 6) AS weight_rank_variance, round(avg(CASE WHEN r <= {_TOP} THEN 1.0 ELSE 0.0 END), 6) AS weight_prob_top_10_percent FROM sr GROUP BY 1",
    "sensitivity_medians": f"{_SE} SELECT round(median(rho), 6) AS spearman, round(median(overlap), 6) AS overlap FROM ss",
    "road_risk": f"{_R} SELECT 'road_' || lpad(CAST(road_id AS VARCHAR), 7, '0') AS road_id, round(len, 6) AS length, round(density, 6) AS density, round(risk, 6) AS estimated_risk FROM risk",
    "road_edges": f"{_R} SELECT edge_id, round(w, 6) AS normal_cost, round(rw, 6) AS risk_cost, round(risk, 6) AS estimated_risk FROM ed",
    "nearest_node": f"{_R} SELECT cell, name AS node, round(d2, 4) AS d2 FROM nn",
    "facility_distance": f"{_PATHS} SELECT name AS node, round(dn.cost, 6) AS normal_cost, round(dr.cost, 6) AS risk_cost FROM dn JOIN dr USING (node) JOIN nd USING (node)",
    "accessibility": f"""{_PATHS} SELECT cell, round(CASE WHEN dn.cost > 0 THEN dn.cost ELSE -1 END, 6) AS normal_facility_cost_m, round(CASE WHEN dn.cost > 0 THEN dr.cost ELSE -1 END, 6) AS risk_adjusted_facility_cost_m,
  round(CASE WHEN dn.cost > 0 THEN least(greatest((dr.cost - dn.cost) / dn.cost, 0), 1) ELSE 1 END, 6) AS accessibility_penalty,
  CASE WHEN dn.cost > 0 THEN 'estimated accessibility risk' ELSE 'estimated isolation under current risk model' END AS accessibility_status FROM nn LEFT JOIN dn USING (node) LEFT JOIN dr USING (node)""",
    "connected_components": f"{_CC} SELECT * FROM cc",
    "component_boxes": f"""{_CC} SELECT tile_id, component, count(*) AS pixel_count, round(min(col) * 10.0::DOUBLE, 6) AS minx, round(min("row") * 10.0::DOUBLE, 6) AS miny, round((max(col) + 1) * 10.0::DOUBLE, 6) AS maxx, round((max("row") + 1) * 10.0::DOUBLE, 6) AS maxy, round((avg(col) + 0.5) * 10.0, 6) AS x, round((avg("row") + 0.5) * 10.0, 6) AS y FROM cc GROUP BY 1, 2""",
    "component_runs": f"""{_CC}, i AS (SELECT *, col - row_number() OVER (PARTITION BY tile_id, component, "row" ORDER BY col) AS k FROM cc)
SELECT tile_id, component, round(min(col) * 10.0::DOUBLE, 6) AS minx, round("row" * 10.0::DOUBLE, 6) AS miny, round((max(col) + 1) * 10.0::DOUBLE, 6) AS maxx, round(("row" + 1) * 10.0::DOUBLE, 6) AS maxy FROM i GROUP BY tile_id, component, "row", k""",
    "display_stretch": """WITH q AS (SELECT event_type, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN hi <= lo THEN 0 ELSE least(greatest((coalesce(value, 0) - lo) / (hi - lo), 0), 1) END, 6) AS stretched FROM events JOIN q USING (event_type)""",
    "mosaic_first": "SELECT o_custkey % 60 AS x, o_orderkey % 50 AS y, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2",
    "raster_normalise": """SELECT user_id, round(min(value), 6) AS raw, round(min(value) / CASE WHEN max(value) > 255 THEN 65535.0 ELSE 255.0 END, 6) AS scaled, round((min(value) - avg(value)) / stddev_pop(value), 6) AS standard
FROM events GROUP BY 1 HAVING stddev_pop(value) > 0""",
}
