import math

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators import calibration, catalog, graph, labelling, metrics, priority, reports, spatial, splits


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_hand_confusion(spark):
    rows = frame(spark, "event_id int, target int, pred int", (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 0), (1, 255, 1))
    counts = metrics.confusion(rows)
    matrix = {(r.target, r.pred): r.n for r in counts.where("event_id = 1").collect()}
    assert len(matrix) == 16 and {k for k, n in matrix.items() if n} == {(0, 0), (1, 1), (2, 2), (3, 0)}
    m = metrics.from_confusion(counts).where("event_id IS NULL").first()
    assert m.accuracy == 0.75 and m.n_pixels == 4
    assert m.class_f1 == pytest.approx([2 / 3, 1, 1, 0]) and m.f1_damage == pytest.approx(2 / 3)


def test_localisation_counts_right_classes_only(spark):
    rows = frame(spark, "event_id int, target int, pred int", (1, 1, 2), (1, 2, 1), (1, 3, 3), (1, 0, 0))
    counts = metrics.confusion(rows).where("event_id = 1")
    assert metrics.from_confusion(counts).first().f1_localization == pytest.approx(1 / 3)
    assert metrics.binary_building_f1(counts).first().f1_building == 1


def test_one_event_has_no_interval(spark):
    rows = frame(spark, "event_id int, target int, pred int", (1, 0, 0), (1, 1, 0))
    got = metrics.bootstrap_events(metrics.confusion(rows), 5).collect()
    assert len(got) == 4 and all(not r.available and r.lower is None for r in got)


def test_lovasz_of_perfect_and_wrong_pixels(spark):
    rows = frame(spark, "g int, target int, p array<double>", (1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.0, 1.0]), (2, 1, [1.0, 0.0]), (2, 255, [1.0, 0.0]))
    got = {r.g: r.lovasz for r in metrics.lovasz(rows, "g", classes=2).collect()}
    assert got == pytest.approx({1: 0.0, 2: 1.0})


def test_bins_at_their_edges(spark):
    values = [i / 15 for i in range(16)] + [math.nextafter(i / 15, 0) for i in range(1, 16)]
    got = frame(spark, "c double", *[(v,) for v in values]).select("c", calibration.bin_of(F.col("c")).alias("b")).collect()
    for r in got:
        want = max(i for i in range(15) if r.c >= i / 15)
        assert r.b == want


def test_reliability_has_empty_bins(spark):
    rows = frame(spark, "logits array<double>, target int", ([9.0, 0.0, 0.0], 0), ([0.0, 0.0, 0.1], 2))
    bins = calibration.reliability(calibration.scored(rows))
    assert bins.count() == 15 and bins.where("count = 0 AND accuracy = 0 AND confidence = 0").count() == 13
    assert 0 < calibration.ece(bins).first().ece < 1


def test_temperature_is_found(spark):
    rows = spark.range(600).select(F.array(F.lit(4.0), F.lit(0.0), F.lit(0.0)).alias("logits"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("target"))
    t = calibration.fit_temperature(rows)
    probability = math.exp(4 / t) / (math.exp(4 / t) + 2)
    assert t > 1 and probability == pytest.approx(2 / 3, abs=1e-2)
    with pytest.raises(ValueError):
        calibration.fit_temperature(rows.limit(0))


def test_softmax_and_its_relatives(spark):
    row = frame(spark, "z array<double>", ([1000.0, 1000.0, 999.0],)).select(C.softmax(F.col("z")).alias("p"), C.argmax(F.col("z")).alias("a")).first()
    assert sum(row.p) == pytest.approx(1) and row.a == 0
    with pytest.raises(ValueError):
        C.softmax(F.col("z"), 0)
    p = F.col("p")
    got = frame(spark, "p array<double>", ([1 / 3, 1 / 3, 1 / 3],), ([1.0, 0.0, 0.0],)).select(C.normalised_entropy(p, 3).alias("e"), C.expected_severity(p).alias("s")).collect()
    assert [r.e for r in got] == pytest.approx([1, 0]) and [r.s for r in got] == pytest.approx([1, 0])
    valid = frame(spark, "p array<double>", ([0.2, 0.3],), ([0.0, 0.0],), ([-0.1, 1.0],), ([float("nan"), 1.0],), (None,)).select(C.valid_probabilities(p).alias("v"))
    assert [r.v for r in valid.collect()] == [True, False, False, False, False]


def test_utm_of_known_points(spark):
    # the equator on a central meridian, and a point of zone 32 computed with published formulae
    rows = frame(spark, "lon double, lat double, zone int", (9.0, 0.0, 32), (11.5755, 48.1374, 32), (9.0, -45.0, 32))
    x, y = C.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    got = rows.select(x.alias("x"), y.alias("y"), C.utm_zone(F.col("lon")).alias("z")).collect()
    assert (got[0].x, got[0].y, got[0].z) == (pytest.approx(500000), pytest.approx(0, abs=1e-6), 32)
    assert got[1].x == pytest.approx(691_600, abs=60) and got[1].y == pytest.approx(5_334_780, abs=60)
    assert got[2].y == pytest.approx(10_000_000 - 4_982_950.4, abs=1)


def test_missing_modality_is_reported(spark):
    a = frame(spark, "tile_id string", ("x",), ("y",))
    b = frame(spark, "tile_id string", ("x",))
    assert [tuple(r) for r in catalog.misaligned({"pre": a, "post": b}).collect()] == [("y", "post")]
    with pytest.raises(ValueError, match="align"):
        catalog.require_none(catalog.misaligned({"pre": a, "post": b}), "Modalities do not align")
    assert catalog.duplicate_ids(a.union(b)).first().tile_id == "x"


def test_bounds_shift_is_a_warning(spark):
    schema = "tile_id string, height int, width int, crs string, bounds array<double>"
    a = frame(spark, schema, ("t", 12, 10, "EPSG:32632", [0.0, 0.0, 10.0, 10.0]))
    b = frame(spark, schema, ("t", 12, 10, "EPSG:32632", [10.0, 0.0, 20.0, 10.0]))
    assert [tuple(r) for r in catalog.alignment_findings(a, b).collect()] == [("t", "bounds", "warning")]
    assert catalog.alignment_findings(a, b, strict=True).first().severity == "error"
    assert catalog.alignment_findings(a, a).count() == 0


def test_unknown_labels(spark):
    rows = frame(spark, "v int", (0,), (3,), (99,), (99,), (255,))
    assert [tuple(r) for r in catalog.label_violations(rows, "v", set(catalog.CLASSES)).collect()] == [(99, 2)]


def test_class_weights(spark):
    got = {r.label: r.weight for r in catalog.class_weights(frame(spark, "label int, n long", (0, 10), (1, 10), (2, 20), (3, 40))).collect()}
    assert sum(got.values()) / 4 == pytest.approx(1) and got[0] == pytest.approx(4 * got[3])
    with pytest.raises(Exception, match="absent"):
        catalog.class_weights(frame(spark, "label int, n long", (0, 10))).collect()


def test_leakage_and_unknown_events(spark):
    tiles = frame(spark, "tile_id string, event_id string", ("a", "e1"), ("b", "e2"), ("c", "e3"))
    with pytest.raises(ValueError, match="Event leakage"):
        splits.holdout_split(tiles, ["e1"], ["e1"])
    with pytest.raises(ValueError, match="Unknown"):
        splits.holdout_split(tiles, ["e1"], ["nowhere"])
    split = splits.holdout_split(tiles, ["e2"], ["e3"])
    assert {r.tile_id: r.partition for r in split.collect()} == {"a": "train", "b": "val", "c": "test"}
    assert splits.leakage(split).count() == 0
    assert (splits.validation_event(tiles, "e3"), splits.validation_event(tiles, "e3", first=True)) == ("e2", "e1")


def test_standard_split_sizes(spark):
    tiles = spark.range(100).select(F.concat(F.lit("t"), F.col("id")).alias("tile_id"), F.when(F.col("id") < 93, "big").when(F.col("id") < 98, "five").otherwise("two").alias("event_id"))
    got = {(r.event_id, r.partition): r["count"] for r in splits.standard_split(tiles).groupBy("event_id", "partition").count().collect()}
    assert got == {("big", "train"): 65, ("big", "val"): 14, ("big", "test"): 14, ("five", "train"): 3, ("five", "val"): 1, ("five", "test"): 1, ("two", "train"): 1, ("two", "test"): 1}


def test_empty_partitions_get_a_tile(spark):
    tiles = frame(spark, "tile_id string, event_id string", ("a", "e"), ("b", "f"), ("c", "g"))
    assert {r.partition for r in splits.standard_split(tiles).collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        splits.standard_split(tiles.limit(1)).collect()


def test_hashed_rank_numbers_every_row(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = splits.hashed_rank(rows, "g", F.md5(F.col("id").cast("string")), "id").collect()
    for g in range(3):
        own = sorted((r["rank"], __import__("hashlib").md5(str(r.id).encode()).hexdigest()) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [d for _, d in own] == sorted(d for _, d in own)


def test_greedy_selection(spark):
    counts = frame(spark, "tile_id string, c1 long, c2 long, c3 long", ("a", 3, 0, 0), ("b", 0, 3, 0), ("c", 0, 0, 3), ("d", 1, 1, 1))
    assert set(splits.greedy_coverage(counts, ["c1", "c2", "c3"], 2)) == {"d", "c"}
    assert len(splits.greedy_coverage(counts, ["c1", "c2", "c3"], 9)) == 4


def test_centre_crop_and_turns(spark):
    tile = frame(spark, "i long, h int, w int", (0, 6, 7))
    plan = splits.geometry_plan(tile, "i", "h", "w", 4, randomise=False).first()
    assert (plan.top, plan.left) == (1, 1)
    cells = [(r, c, 2, 3, True, False, 1) for r in range(2) for c in range(3)]
    px = frame(spark, "row int, col int, height int, width int, hflip boolean, vflip boolean, quarter_turns int", *cells).withColumn("v", F.col("row") * 3 + F.col("col"))
    import numpy as np

    want = np.rot90(np.arange(6).reshape(2, 3)[:, ::-1])
    got = {(r.row, r.col): r.v for r in splits.apply_plan(px, None).collect()}
    assert got == {(i, j): int(want[i, j]) for i in range(3) for j in range(2)}


def test_small_tiles_are_padded(spark):
    cells = [("t", r, c, 6, 7, r * 7 + c) for r in range(6) for c in range(7)]
    px = frame(spark, "tile_id string, row int, col int, height int, width int, value int", *cells)
    edge = {(r.row, r.col): r.value for r in splits.padded(px, 8).collect()}
    assert len(edge) == 64 and edge[7, 7] == 41 and edge[0, 7] == 6 and edge[7, 0] == 35 and edge[2, 3] == 17
    zero = {(r.row, r.col): (r.value, r.height, r.width) for r in splits.padded(px, 8, "zero").collect()}
    assert zero[7, 7] == (0, 8, 8) and zero[5, 6] == (41, 8, 8)
    assert splits.padded(px, 4).count() == 42


def test_weighted_losses(spark):
    rows = frame(spark, "g int, target int, logits array<double>", (1, 0, [0.0, 0.0]), (1, 1, [0.0, math.log(3)]), (1, 255, [5.0, 0.0]))
    plain = metrics.cross_entropy(rows, ["g"]).first().cross_entropy
    assert plain == pytest.approx((math.log(2) + math.log(4 / 3)) / 2)
    weighted = metrics.cross_entropy(rows, ["g"], {0: 1.0, 1: 3.0}).first().cross_entropy
    assert weighted == pytest.approx((math.log(2) + 3 * math.log(4 / 3)) / 4)
    focal = metrics.cross_entropy(rows, ["g"], gamma=1.0).first().cross_entropy
    assert focal == pytest.approx((math.log(2) / 2 + math.log(4 / 3) / 4) / 2)
    heads = metrics.head_targets(frame(spark, "target int", (0,), (2,), (255,))).collect()
    assert [(r.location_target, r.damage_target) for r in heads] == [(0, 255), (1, 1), (255, 255)]


def test_components_touch_diagonally(spark):
    mask = frame(spark, "tile_id long, row int, col int", (1, 0, 0), (1, 1, 1), (1, 3, 3), (2, 0, 0), (1, 0, 4), (1, 1, 0))
    eight = {(r.tile_id, r.row, r.col): r.component for r in labelling.connected_components(mask, width=5).collect()}
    assert eight[1, 0, 0] == eight[1, 1, 1] == eight[1, 1, 0] == 0 and eight[1, 3, 3] == 18 and eight[2, 0, 0] == 0 and eight[1, 0, 4] == 4
    four = labelling.connected_components(mask.where("NOT (row = 1 AND col = 0)"), 4, 5)
    assert {r.component for r in four.where("tile_id = 1").collect()} == {0, 4, 6, 18}
    long = spark.range(200).select(F.lit(1).alias("tile_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"))
    assert labelling.connected_components(long, width=1000).select("component").distinct().count() == 1


def test_majority_ties_go_to_the_lowest(spark):
    px = frame(spark, "component int, label int", (1, 2), (1, 1), (1, 1), (1, 2), (2, 3))
    assert {r.component: r.target_class_id for r in calibration.majority_class(px, ["component"]).collect()} == {1: 1, 2: 3}


def test_edges_of_cells_hold_no_building(spark):
    grid = spatial.lattice((0.0, 0.0, 1200.0, 700.0), 500.0)
    assert grid == (0, 0, 3, 2)
    pts = frame(spark, "x double, y double", (10.0, 10.0), (500.0, 10.0), (510.0, 600.0), (-5.0, 5.0))
    got = pts.select(spatial.cell_of(F.col("x"), F.col("y"), grid, 500.0).alias("c")).collect()
    assert [r.c for r in got] == [0, None, 3, None]
    assert spatial.lattice((0.0, 0.0, 0.0, 0.0), 500.0)[2:] == (0, 0)
    cells = spatial.decision_grid(spark, grid, 500.0).collect()
    assert len(cells) == 6 and cells[3].cell_id == "cell_000003" and (cells[3].minx, cells[3].miny) == (500, 500)


def test_near_segments_match_brute_force(spark):
    import random

    rng = random.Random(1)
    pts = [(i, rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(400)]
    segs = [(i, *(rng.uniform(0, 5000) for _ in range(4))) for i in range(40)] + [(40, 100.0, 0.0, 100.0, 4000.0), (41, 0.0, 700.0, 4000.0, 700.0), (42, 5.0, 5.0, 5.0, 5.0)]

    def d2(p, s):
        (x, y), (ax, ay, bx, by) = p, s
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, 0), 1) if n else 0
        return (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2

    want = {(i, s[0]) for i, x, y in pts for s in segs if d2((x, y), s[1:]) <= 125**2}
    a, b = frame(spark, "p int, x double, y double", *pts), frame(spark, "s int, ax double, ay double, bx double, by double", *segs)
    got = [(r.p, r.s) for r in spatial.near_segments(a, b, 125.0).select("p", "s").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("unit", [20, 300, 50_000])
def test_sums_near_segments_match_all_pairs_and_make_none(spark, monkeypatch, unit):
    import numpy as np

    rng = np.random.default_rng(5)
    spread, dense = rng.uniform(-2_000, 2_000, (900, 2)), rng.normal(500, 20, (600, 2))
    xy = np.concatenate([spread, dense, np.full((100, 2), 510.0), [[9e4, -7e4]]])
    value = rng.uniform(0, 1, len(xy))
    ends = rng.uniform(-2_500, 2_500, (60, 4))
    ends[:4, 2:] = ends[:4, :2]  # without length
    ends[4:8, 2] = ends[4:8, 0]  # upright
    points = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(xy, value, strict=True)] + [(None, 1.0, 1.0), (1.0, 1.0, None)], "x double, y double, v double")
    segments = spark.createDataFrame([(f"s{i}", *map(float, e)) for i, e in enumerate(ends)], "s string, ax double, ay double, bx double, by double")
    got = {r.s: (r.n, r.total) for r in spatial.near_sums(points, segments, 125.0, "s", "v", unit).collect()}
    xy, value = np.concatenate([xy, [[1.0, 1.0]]]), np.append(value, 0.0)
    for i, (ax, ay, bx, by) in enumerate(ends):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((xy[:, 0] - ax) * (bx - ax) + (xy[:, 1] - ay) * (by - ay)) / (square or 1.0), 0, 1)
        hit = (xy[:, 0] - ax - t * (bx - ax)) ** 2 + (xy[:, 1] - ay - t * (by - ay)) ** 2 <= 125.0**2
        n, total = got.pop(f"s{i}", (0, 0.0))
        assert n == hit.sum() and abs(total - value[hit].sum()) < 1e-9
    assert not got

    def pairs(*_, **__):
        raise AssertionError("pairs of buildings and roads were made")

    monkeypatch.setattr(spatial, "near_segments", pairs)
    monkeypatch.setattr(graph, "near_segments", pairs, raising=False)
    roads = segments.withColumn("road_id", F.expr("CAST(substr(s, 2) AS BIGINT)")).drop("s")
    assert graph.road_risk(roads, points.withColumnRenamed("v", "p_destroyed")).count() == 56


def test_nearest_node_also_far_away(spark):
    nodes = frame(spark, "node string, x double, y double", ("b", 10.0, 0.0), ("a", -10.0, 0.0), ("far", 1e5, 1e5))
    pts = frame(spark, "k int, x double, y double", (1, 0.0, 0.0), (2, 9e4, 9e4), (3, -4e5, 0.0))
    got = {r.k: r.node for r in spatial.nearest(pts, nodes, "k").collect()}
    assert got == {1: "a", 2: "far", 3: "a"}
    with pytest.raises(ValueError):
        spatial.nearest(pts, nodes.limit(0), "k")


@pytest.mark.parametrize("kind", ["spread", "clusters", "line"])
def test_nearest_nodes_match_all_pairs_with_few_candidates(spark, kind):
    import random

    rng = random.Random(len(kind))
    if kind == "spread":
        at = [(rng.random() * 1e4, rng.random() * 1e4) for _ in range(1500)]
    elif kind == "clusters":  # most nodes in a hundredth of the width, some far away, some in one place
        at = [(5e3 + rng.gauss(0, 20), 1e3 + rng.gauss(0, 20)) for _ in range(1400)] + [(rng.random() * 1e6, rng.random() * 1e6) for _ in range(50)] + [(7.0, 7.0)] * 5
    else:
        at = [(float(i % 700), 3.0) for i in range(1400)]
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "node long, x double, y double")
    asked = [(i, *rng.choice(at)) if i % 4 else (i, rng.random() * 2e4, rng.random() * 2e4) for i in range(200)] + [(900, -3e6, 5e5), (901, 5e3, 9e6), (902, None, 1.0)]
    points = spark.createDataFrame(asked, "k long, x double, y double")
    got = {r.k: (r.d2, at[r.node]) for r in spatial.nearest(points, nodes, "k", most=8).collect()}
    want = {k: min(((x - a) * (x - a) + (y - b) * (y - b), (a, b)) for a, b in at) for k, x, y in asked if x is not None}
    assert got == want
    named = nodes.toDF("__node", "__x", "__y")
    leaves, levels = spatial.pyramid(named, 8)
    assert kind != "spread" or leaves.groupBy("ix", "iy").count().agg(F.max("count")).first()[0] <= 8
    for level in spatial.candidates(points, levels, "k"):
        assert level.groupBy("k").count().agg(F.max("count")).first()[0] <= 24


def test_graph_keeps_shorter_edges_and_finds_paths(spark):
    roads = frame(spark, "road_id long, ax double, ay double, bx double, by double, length double, estimated_risk double",
        (0, 0.0, 0.0, 3.0, 0.0, 3.0, 0.0), (1, 3.0, 0.0, 0.0, 0.0, 3.0, 1.0), (2, 3.0, 0.0, 3.0, 4.0, 4.0, 0.5), (3, 9.0, 9.0, 9.0, 8.0, 1.0, 0.0), (4, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0))
    edges = graph.edges(roads)
    assert sorted((r.edge_id, r.risk_cost) for r in edges.collect()) == [(0, 3.0), (2, 12.0), (3, 1.0)]
    start = edges.where("edge_id = 0").select(F.col("u").alias("node"))
    got = {(r.node.x, r.node.y): r.cost for r in graph.distances(edges, start, "normal_cost").collect()}
    assert got == {(0, 0): 0, (3, 0): 3, (3, 4): 7}
    cells = frame(spark, "cell int, node int", (1, 1), (2, 2), (3, 3))
    base, risk = frame(spark, "node int, cost double", (1, 0.0), (2, 10.0)), frame(spark, "node int, cost double", (1, 0.0), (2, 14.0))
    rows = {r.cell: r for r in graph.accessibility(cells, base, risk).collect()}
    assert rows[2].accessibility_penalty == pytest.approx(0.4) and rows[1].accessibility_penalty == rows[3].accessibility_penalty == 1
    assert rows[1].normal_facility_cost_m is None


def test_segments_of_lines(spark):
    roads = frame(spark, "road_id int, coords array<struct<x: double, y: double>>", (1, [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 2.0)]), (2, [(0.0, 0.0)]), (3, [(1.0, 1.0), (1.0, 1.0)]))
    assert [r.road_id for r in graph.usable_lines(roads).collect()] == [1]
    assert [(r.place, r.bx, r.by) for r in graph.segments(roads).collect()] == [(0, 1, 0), (2, 1, 2)]


def _cells(spark, n=40):
    c = F.col("id").cast("double")
    return spark.range(n).select(F.col("id").alias("cell"), c.alias("expected_damaged_buildings"), (c / 2).alias("expected_destroyed_buildings"), (c * 10).alias("population_total"), (c / n).alias("accessibility_penalty"))


def test_priority_rises_with_damage(spark):
    rows = priority.prioritise(_cells(spark)).orderBy("cell").collect()
    scores = [r.priority_score for r in rows]
    assert scores == sorted(scores) and rows[-1].priority_rank == 1 and rows[0].priority_rank == 40
    assert rows[-1].relative_priority_band == "CRITICAL" and rows[0].relative_priority_band == "LOW"
    assert sum(r.relative_priority_band == "CRITICAL" for r in rows) == 4


def test_constant_scores_are_all_critical(spark):
    same = _cells(spark).select("cell", *[F.lit(1.0).alias(c) for c in ("expected_damaged_buildings", "expected_destroyed_buildings", "population_total", "accessibility_penalty")])
    rows = priority.prioritise(same).collect()
    assert {r.relative_priority_band for r in rows} == {"CRITICAL"} and sorted(r.priority_rank for r in rows) == list(range(1, 41))
    assert {r.damage_score for r in rows} == {0.0}


def test_weights_renormalise():
    assert sum(priority.available_weights().values()) == pytest.approx(1)
    assert priority.available_weights(hazard=True) == pytest.approx(priority.WEIGHTS)
    with pytest.raises(ValueError):
        priority.available_weights({"damage": -1, "population": 2})


def test_draws_by_rows_are_the_digests(monkeypatch):
    import hashlib

    from cairnfield.functions import arrays

    keys = ["7", "80", "81", "x" * 60, "ä", "", "123456789012345678901234567890123456789012"]
    for tag, n, first in (("mc42", 1_200, 0), ("place42", 20_000, 95), ("t", 3, 9)):
        got = arrays.uniform_rows(tag, keys, n, first)
        for row, k in zip(got, keys, strict=True):
            for i in (0, 1, n // 2, n - 2, n - 1, *range(min(n, 60))):
                assert row[i] == int(hashlib.md5(f"{tag}:{k}:{first + i}".encode()).hexdigest()[:8], 16) / 2**32

    def one(*_, **__):
        raise AssertionError("digests are made one by one")

    monkeypatch.setattr(arrays.hashlib, "md5", one)
    assert arrays.uniform_rows("mc42", [str(i) for i in range(100, 200)], 500).shape == (100, 500)


def test_simulations_repeat_and_agree_with_certainty(spark):
    cells = priority.components(_cells(spark))
    b = spark.range(200).select(F.col("id").alias("building_id"), (F.col("id") % 40).alias("cell"), F.lit(0.0).alias("p_intact"), F.lit(0.0).alias("p_damaged"), F.lit(2.0).alias("p_destroyed"))
    first = priority.monte_carlo(cells, b, 3).collect()
    assert sorted(map(str, first)) == sorted(map(str, priority.monte_carlo(cells, b, 3).collect()))
    assert len(first) == 120 and {r.sim for r in first} == {0, 1, 2}
    u = priority.uncertainty(priority.monte_carlo(cells, b, 3), 40).collect()
    assert all(r.priority_p05 == pytest.approx(r.priority_p95) for r in u)
    assert sum(r.prob_top_10_percent for r in u) == pytest.approx(4)


def test_single_cell_sensitivity(spark):
    rows = priority.prioritise(_cells(spark, 1))
    draws = priority.sensitivity_draws(rows, priority.weight_draws(spark, 3))
    assert [r.spearman_rank_correlation for r in priority.sensitivity(draws, 1).collect()] == [1, 1, 1]


def test_reports(spark):
    text = reports.markdown_table(frame(spark, "a string, b double", ("x", 0.5)), ["a", "b"], "a")
    assert text == "| a | b |\n| --- | --- |\n| x | 0.5000 |"
    runs = frame(spark, "run string", ("m3_heldout",), ("m3",)).select(reports.protocol(F.col("run")).alias("p"))
    assert [r.p for r in runs.collect()] == ["event_held_out", "standard"]
    history = frame(spark, "run int, epoch int, f double", (1, 1, 0.5), (1, 2, 0.7), (1, 3, 0.7))
    assert reports.best_epoch(history, ["run"], "f").first().epoch == 2
    assert [r.is_best for r in reports.records_so_far(history, ["run"], "f").orderBy("epoch").collect()] == [True, True, False]


def test_draws_and_ranges_are_the_references():
    from cairnfield.plans import metric_queries, priority_queries

    assert (priority_queries.SIMULATIONS, priority_queries.SAMPLES, metric_queries.DRAWS) == (500, 1000, 1000)
    assert priority.RANGES == {"damage": (0.25, 0.55), "population": (0.15, 0.40), "accessibility": (0.10, 0.30), "hazard": (0.0, 0.20)}


def test_bootstrap_draws_buildings_with_replacement(spark):
    import numpy as np

    rows = calibration.scored(spark.range(90).select("id", (F.col("id") % 3).alias("target"), F.array((F.col("id") % 5).cast("double"), (F.col("id") % 7).cast("double"), F.lit(2.0)).alias("logits")))
    for in_slice in (1_000, 20):
        got = {r.metric: (r.lower, r.upper) for r in calibration.bootstrap(rows, 300, "id", in_slice=in_slice).collect()}
        assert set(got) == set(calibration.METRICS)
        own = [(r.p, r.target) for r in rows.collect()]
        rng = np.random.default_rng(0)
        brier = np.array([sum((x - (k == t)) ** 2 for k, x in enumerate(p)) for p, t in own])
        plain = np.percentile([brier[rng.integers(0, 90, 90)].mean() for _ in range(4000)], [2.5, 97.5])
        assert got["brier"] == pytest.approx(tuple(plain), rel=0.06)
        assert all(low <= high for low, high in got.values())
    counts = calibration._picks(spark, 50, 90, np.array([10, 0, 55, 25]), 42).groupBy("draw").agg(F.sum("c").alias("n")).collect()
    assert len(counts) == 50 and {r.n for r in counts} == {90}
    assert calibration.bootstrap(rows.limit(0), 5, "id").count() == 0


@pytest.mark.parametrize("in_range", [7, 1_000_000])
def test_simulated_vectors_match_simulated_rows(spark, in_range):
    from cairnfield.operators import simulation

    cells = priority.components(_cells(spark, 60)).withColumn("population_score", F.when(F.col("cell") < 30, 0.5).otherwise(F.col("population_score"))).withColumn("accessibility_score", F.lit(0.25))
    b = spark.range(300).select(F.col("id").alias("building_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 45).alias("cell"), F.lit(0.5).alias("p_intact"), (F.col("id") % 3 / 10).alias("p_damaged"), F.lit(0.3).alias("p_destroyed"))
    want = {r.cell: r for r in priority.uncertainty(priority.monte_carlo(cells, b, 12), 60).collect()}
    got = {r.cell: r for r in simulation.uncertainty(cells, b, 12, in_range=in_range).collect()}
    assert set(got) == set(want) == set(range(60))
    for cell, r in got.items():
        assert r.asDict() == pytest.approx(want[cell].asDict(), abs=1e-12)
    assert simulation.uncertainty(cells.limit(0), b, 3).count() == 0
    alone = simulation.uncertainty(cells, b.limit(0), 3).collect()
    assert len(alone) == 60 and all(r.rank_p05 == r.rank_p95 for r in alone)


def test_distances_never_stop_short(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "u long, v long, w double")
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError, match="3 rounds"):
        graph.distances(chain, start, "w", most_rounds=3, block=1)
    assert graph.distances(chain, start, "w", most_rounds=1).count() == 5  # one block


def plain_distances(edges, sources):
    import heapq

    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    cost, queue = {}, [(0.0, s) for s in sources]
    while queue:
        d, n = heapq.heappop(queue)
        if n not in cost:
            cost[n] = d
            for m, w in near.get(n, []):
                heapq.heappush(queue, (d + w, m))
    return cost


@pytest.mark.parametrize("places", [True, False])
def test_distances_over_blocks_match_a_plain_search(spark, places):
    import random

    rng = random.Random(9)
    at = {i: (round(rng.random() * 100, 3), round(rng.random() * 100, 3)) for i in range(400)}
    edges = []
    for i in range(400):
        for j in rng.sample(range(400), 12):
            d = ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2) ** 0.5
            if 0 < d < 14 or rng.random() < 0.002:
                edges.append((i, j, float(int(d * 8 + 1))))
    sources = [3, 77, 399, 1000]  # the last has no edges
    at[1000] = (50.0, 50.0)
    name = (lambda i: at[i]) if places else (lambda i: i)
    kind = "struct<x: double, y: double>" if places else "long"
    graph_ = spark.createDataFrame([(name(a), name(b), w) for a, b, w in edges] + [(name(5), None, 1.0), (name(5), name(6), None)], f"u {kind}, v {kind}, w double")
    start = spark.createDataFrame([(name(s),) for s in sources * 2] + [(None,)], f"node {kind}")
    want = {name(n): d for n, d in plain_distances(edges, sources).items()}
    rows = graph.distances(graph_, start, "w", block=60 if places else 10_000).collect()
    got = {(tuple(r.node) if places else r.node): r.cost for r in rows}
    assert len(rows) == len(got) and got == want
    if not places:
        assert graph.distances(graph_, start.limit(0), "w").count() == 0
        with pytest.raises(Exception, match="negative"):
            graph.distances(graph_.withColumn("w", -F.col("w")), start, "w")


def test_a_long_chain_is_written_about_once(spark, monkeypatch):
    from cairnfield.operators import paths

    written = []
    monkeypatch.setattr(paths, "kept", lambda df, own=paths.kept: written.append(own(df)) or written[-1])
    monkeypatch.setattr(paths, "released", lambda df: None)
    chain = spark.range(10_000).selectExpr("id AS u", "id + 1 AS v", "1.0D AS w")
    start = spark.createDataFrame([(4_000,)], "node long")
    found = paths.distances(chain, start, "w", block=1_000)
    assert found.count() == 10_001 and found.where("cost <> abs(node - 4000)").count() == 0
    logs = [w for w in written if w.columns == ["block", "kind", "keys", "values"]][1:]  # without the edges
    assert len(logs) < 12 and sum(r.n or 0 for w in logs for r in w.selectExpr("sum(length(values)) DIV 8 AS n").collect()) < 2.2 * 10_001


def test_quantiles_and_numbers_of_ties(spark):
    from cairnfield.operators import order

    rows = spark.range(30_000).selectExpr("id", "id % 3 AS g", "IF(id % 5 < 4, 0.0, sqrt(id)) AS v", "IF(id % 7 = 0, NULL, sin(id)) AS w").checkpoint()
    wanted = {f"{c}{q}": (F.col(c), q) for c in "vw" for q in (0.0, 0.02, 0.5, 0.81, 0.98, 1.0)}
    expected = [F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()]
    assert order.quantiles(rows, wanted).first().asDict() == rows.agg(*expected).first().asDict()
    by_group = {r["g"]: r.asDict() for r in order.quantiles(rows, wanted, ["g"]).collect()}
    assert by_group == {r["g"]: r.asDict() for r in rows.groupBy("g").agg(*expected).collect()}
    for few in (1, 2, 7, 174):
        some = rows.where(F.col("id") % 100 < 3).limit(few)
        assert order.quantiles(some, wanted).first().asDict() == some.agg(*expected).first().asDict()
    assert set(order.quantiles(rows.limit(0), wanted).first()) == {None}
    assert not order.quantiles(rows.limit(0), wanted, ["g"]).count()
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # else so few rows are one range
    try:
        ranges = order.numbered(rows, [F.col("v").desc(), F.col("id").asc()], "n")
        by_value = sorted(rows.collect(), key=lambda r: (-r["v"], r["id"]))
        assert {r["id"]: r["n"] for r in ranges.collect()} == {r["id"]: i for i, r in enumerate(by_value, 1)}
        grouped = order.numbered(rows, [F.col("v").desc(), F.col("id").asc()], "n", ["g"])
        counts = grouped.groupBy("g").agg(F.min("n"), F.max("n"), F.count_distinct("n"))
        assert {tuple(r)[1:] for r in counts.collect()} == {(1, 10_000, 10_000)}
    finally:
        spark.conf.set(setting, before)
