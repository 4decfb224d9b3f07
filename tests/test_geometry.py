import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from cairnfield.sources import geometry as G

SHAPES = [
    (1, [[[(1.5, -2.0)]]]),
    (2, [[[(0.0, 0.0), (3.0, 4.0), (1e9, -1e-9)]]]),
    (3, [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (2.0, 2.0)]]]),
    (4, [[[(0.0, 1.0)]], [[(2.0, 3.0)]]]),
    (5, [[[(0.0, 0.0), (1.0, 1.0)]], [[(5.0, 5.0), (6.0, 6.0), (7.0, 5.0)]]]),
    (6, [[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]], [[(5.0, 5.0), (9.0, 5.0), (9.0, 9.0), (5.0, 5.0)], [(7.0, 6.0), (8.0, 6.0), (8.0, 7.0), (7.0, 6.0)]]]),
]


def frame(spark, shapes):
    rows = [(i, None if s is None else (s[0], [[[tuple(p) for p in ring] for ring in part] for part in s[1]])) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, f"id int, geometry {G.GEOMETRY}")


def plain(value):
    return None if value is None else (value["kind"], [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in value["parts"]])


def wkb(kind, parts, order="<", code=None, height=None, srid=None) -> bytes:
    """A plain writer of the standard form, to compare with."""
    flag = b"\x01" if order == "<" else b"\x00"
    head = flag + struct.pack(order + "I", code or kind) + (struct.pack(order + "I", srid) if srid else b"")
    at = lambda p: struct.pack(order + ("2d" if height is None else "3d"), *p, *([] if height is None else [height]))
    run = lambda ring: struct.pack(order + "I", len(ring)) + b"".join(map(at, ring))
    if kind == 1:
        return head + at(parts[0][0][0])
    if kind == 2:
        return head + run(parts[0][0])
    if kind == 3:
        return head + struct.pack(order + "I", len(parts[0])) + b"".join(map(run, parts[0]))
    return head + struct.pack(order + "I", len(parts)) + b"".join(wkb(kind - 3, [p], order, code and code - 3, height) for p in parts)


def test_binary_form_both_ways(spark):
    shapes = [*SHAPES, None]
    rows = frame(spark, shapes).withColumn("b", G.to_wkb(spark, "geometry")).withColumn("back", G.from_wkb(spark, "b")).orderBy("id").collect()
    for r, s in zip(rows, shapes, strict=True):
        assert (None if r.b is None else bytes(r.b)) == (None if s is None else wkb(*s))
        assert plain(r.back) == s


def test_other_writers_forms_are_read(spark):
    given = [(wkb(*s, order=">"), s) for s in SHAPES] + [(wkb(*s, code=s[0] + 1000, height=7.0), s) for s in SHAPES]
    given += [(wkb(*s, code=s[0] | 0x80000000, height=7.0), s) for s in SHAPES[:3]] + [(wkb(*s, code=s[0] | 0x20000000, srid=32632), s) for s in SHAPES[:3]]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(given)], "id int, b binary").withColumn("g", G.from_wkb(spark, "b")).orderBy("id").collect()
    assert [plain(r.g) for r in rows] == [s for _, s in given]
    with pytest.raises(Exception, match="not read"):
        spark.createDataFrame([(struct.pack("<BI", 1, 17),)], "b binary").select(G.from_wkb(spark, "b")).collect()


def test_empty_geometries(spark):
    empty = [(1, []), (2, [[[]]]), (3, [[]]), (4, []), (6, [])]
    rows = frame(spark, empty).withColumn("back", G.from_wkb(spark, G.to_wkb(spark, "geometry"))).withColumn("box", G.bbox(F.col("geometry"))).orderBy("id").collect()
    assert [plain(r.back) for r in rows] == empty and all(r.box is None for r in rows)


def test_boxes_and_areas(spark):
    rows = frame(spark, SHAPES).select("id", G.bbox(F.col("geometry")).alias("b"), G.area(F.col("geometry")).alias("a")).orderBy("id").collect()
    for r, (_, parts) in zip(rows, SHAPES, strict=True):
        xs, ys = zip(*[p for part in parts for ring in part for p in ring], strict=True)
        assert tuple(r.b) == (min(xs), min(ys), max(xs), max(ys))
    assert [r.a for r in rows] == [0.0, 0.0, 98.0, 0.0, 0.0, 0.5 + 8.0 - 0.5]


def points(spark, n=20_000):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.random() * 1000, rng.random() * 1000) for i in range(n)], "id int, x double, y double")
    return rows.select("id", "x", "y", G.point(F.col("x"), F.col("y")).alias("geometry"))


def test_box_queries_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = points(spark).union(spark.createDataFrame([(-1, None, None)], "id int, x double, y double").withColumn("geometry", F.lit(None).cast(G.GEOMETRY)))
    G.write_geometries(rows, path, "EPSG:32632", row_group=64 << 10)
    for within in ((100.0, 100.0, 180.0, 150.0), (0.0, 990.0, 1000.0, 1000.0)):
        found = G.read_geometries(spark, path, within, decode=False).select("id")
        got = {r.id for r in found.collect()}
        assert got == {r.id for r in rows.where(F.col("x").between(within[0], within[2]) & F.col("y").between(within[1], within[3])).collect()}
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert len(got) <= read < 6_000  # of 20,001
    whole = G.read_geometries(spark, path)
    assert whole.count() == 20_001 and G.crs_of(whole) == "EPSG:32632"
    about = json.loads((tmp_path / "t" / "_geo.json").read_text())
    assert about["primary_column"] == "geometry" and about["columns"]["geometry"]["geometry_types"] == ["Point"]


def test_reference_systems_must_agree(spark, tmp_path):
    for name, crs in (("a", "EPSG:32632"), ("b", "EPSG:4326"), ("c", None)):
        G.write_geometries(points(spark, 5), str(tmp_path / name), crs)
    a, b, c = (G.read_geometries(spark, str(tmp_path / n)) for n in "abc")
    assert G.require_same_crs(a, a) == "EPSG:32632"
    with pytest.raises(ValueError, match="differ"):
        G.require_same_crs(a, b)
    with pytest.raises(ValueError, match="no reference system"):
        G.require_same_crs(a, c)
    G.write_geometries(points(spark, 5).limit(0), str(tmp_path / "none"), "EPSG:4326")
    assert G.read_geometries(spark, str(tmp_path / "none"), (0.0, 0.0, 1.0, 1.0)).count() == 0


# outlines of masks


def flood(pixels: set, near) -> dict:
    """The least pixel of each pixel's component."""
    label = {}
    for start in sorted(pixels):
        if start in label:
            continue
        label[start], stack = start, [start]
        while stack:
            r, c = stack.pop()
            for dr, dc in near:
                q = (r + dr, c + dc)
                if q in pixels and q not in label:
                    label[q] = start
                    stack.append(q)
    return label


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def inside(shape, x: float, y: float) -> bool:
    """Even or odd crossings to the left, over all rings."""
    odd = False
    for part in shape["parts"]:
        for ring in part:
            for a, b in zip(ring, ring[1:]):
                if (a["y"] < y) != (b["y"] < y) and a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) < x:
                    odd = not odd
    return odd


@pytest.mark.parametrize("block", [6, 64])
def test_polygons_are_the_masks(spark, block):
    from cairnfield.operators import labelling

    rng = random.Random(block)
    side, masks = 13, {}
    for tile, density in enumerate((0.3, 0.5, 0.75)):
        masks[tile] = {(r, c) for r in range(side) for c in range(side) if rng.random() < density}
    masks[3] = {(r, c) for r in range(side) for c in range(side) if not (r % 4 == 1 and 0 < c < side - 1 and c % 3)}  # many holes
    masks[4] = {(0, 0), (1, 1), (2, 2), (2, 0), (1, 3)}
    mask = spark.createDataFrame([(t, r, c) for t, m in masks.items() for r, c in m] + [(4, 0, 0)] * 3, "tile_id long, row int, col int")
    labels = {(r.tile_id, r.row, r.col): r.component for r in labelling.connected_components(mask, 8, 100, block).collect()}
    want = {(t, *p): q[0] * 100 + q[1] for t, m in masks.items() for p, q in flood(m, EIGHT).items()}
    assert labels == want
    rows = labelling.polygonise(mask, 100, block).withColumn("area", G.area(F.col("geometry"))).withColumn("p", G.interior_point(F.col("geometry"))).collect()
    assert {(r.tile_id, r.component) for r in rows} == {(k[0], v) for k, v in want.items()}
    for r in rows:
        own = {k[1:] for k, v in want.items() if (k[0], v) == (r.tile_id, r.component)}
        assert r.pixel_count == len(own) == r.area
        parts = len(set(flood(own, FOUR).values()))
        outside = {(y, x) for y in range(-1, side + 1) for x in range(-1, side + 1)} - own
        lone = flood(own, FOUR)  # around each part, what shares sides and isn't the outside is a hole
        assert r.n_holes == sum(len(set(flood((own | outside) - {p for p in own if lone[p] == part}, FOUR).values())) - 1 for part in set(lone.values()))
        assert len(r.geometry["parts"]) == parts and r.geometry["kind"] == (3 if parts == 1 else 6)
        assert {(y, x) for y, x in own | outside if inside(r.geometry, x + 0.5, y + 0.5)} == own
        for part in r.geometry["parts"]:
            for ring in part:
                assert ring[0] == ring[-1] and len(ring) >= 5
                assert all((a["x"] == b["x"]) != (b["x"] == c["x"]) for a, b, c in zip(ring, ring[1:], ring[2:]))
        assert (int(r.p.y), int(r.p.x)) in own and inside(r.geometry, r.p.x, r.p.y)


def test_points_lie_inside_of_any_polygon(spark):
    shapes = [
        (3, [[[(0.0, 0.0), (10.0, 0.0), (10.0, 9.0), (5.0, 1.0), (0.0, 9.0), (0.0, 0.0)]]]),
        (3, [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 8.0), (8.0, 8.0), (8.0, 1.0), (1.0, 1.0)]]]),
        SHAPES[5],
        SHAPES[1],
        (3, []),
        None,
    ]
    rows = frame(spark, shapes).withColumn("p", G.interior_point(F.col("geometry"))).orderBy("id").collect()
    for r in rows[:3]:
        assert inside(r.geometry, r.p.x, r.p.y)
    assert [r.p for r in rows[3:]] == [None, None, None]


def test_affine_and_empty_masks(spark):
    from cairnfield.operators import labelling

    mask = spark.createDataFrame([("t", 2, 3)], "tile_id string, row int, col int")
    (r,) = labelling.polygonise(mask, affine=(500.0, 2.0, 900.0, -2.0)).collect()
    assert plain(r.geometry)[0] == 3 and {tuple(p) for p in plain(r.geometry)[1][0][0]} == {(506.0, 896.0), (508.0, 896.0), (508.0, 894.0), (506.0, 894.0)}
    assert labelling.polygonise(mask.limit(0)).count() == 0 and labelling.connected_components(mask.limit(0)).count() == 0


# roads and polygons


def apart(s, t) -> float:
    """Distance of two segments ((x, y), (x, y)), from its definition."""

    def to(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        k = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return ((p[0] - a[0] - k * dx) ** 2 + (p[1] - a[1] - k * dy) ** 2) ** 0.5

    side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    if side(t[0], *s) * side(t[1], *s) < 0 and side(s[0], *t) * side(s[1], *t) < 0:
        return 0.0
    return min(to(t[0], *s), to(t[1], *s), to(s[0], *t), to(s[1], *t))


def test_roads_near_concave_polygons_with_holes(spark):
    from cairnfield.operators import spatial

    rng = random.Random(4)
    outer = [(0, 0), (60, 0), (60, 50), (45, 50), (45, 10), (15, 10), (15, 50), (0, 50), (0, 0)]  # a U
    hole = [(3, 12), (3, 40), (12, 40), (12, 12), (3, 12)]
    shapes = {}
    for i in range(60):
        x, y, k = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([1.0, 1.0, 6.0])
        shapes[i] = (3, [[[(x + k * a, y + k * b) for a, b in ring] for ring in (outer, hole)]])
    roads = [(j, *(rng.uniform(-600, 600) for _ in range(2)), *(rng.uniform(-60, 60) for _ in range(2))) for j in range(150)]
    roads = [(j, x, y, x + dx, y + dy) for j, x, y, dx, dy in roads] + [(900, 0.0, 0.0, 0.0, 0.0), (901, -900.0, -900.0, 900.0, 900.0)]
    got = spatial.near_polygons(frame(spark, [shapes[i] for i in range(60)]), spark.createDataFrame(roads, "road int, ax double, ay double, bx double, by double"), 9.0, "id", "road").collect()
    want = set()
    for i, (_, parts) in shapes.items():
        sides = [pair for ring in parts[0] for pair in zip(ring, ring[1:])]
        shape = {"parts": [[[{"x": p[0], "y": p[1]} for p in ring] for ring in part] for part in parts]}
        for j, ax, ay, bx, by in roads:
            if inside(shape, ax, ay) or min(apart(e, ((ax, ay), (bx, by))) for e in sides) <= 9.0:
                want.add((i, j))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(inside({"parts": [[[{"x": p[0], "y": p[1]} for p in ring] for ring in shapes[i][1][0]]]}, *next((r[1], r[2]) for r in roads if r[0] == j)) for i, j in want)
    # the same as sums, without pairs; one polygon is far larger, and many lie in few places
    for unit in (7, 50_000):
        valued = frame(spark, [shapes[i] for i in range(60)]).withColumn("value", 1 + F.col("id") / 64)
        sums = spatial.near_polygon_sums(valued, spark.createDataFrame(roads, "road int, ax double, ay double, bx double, by double"), 9.0, "road", "value", unit=unit)
        of = {j: [1 + i / 64 for i, k in want if k == j] for j in {k for _, k in want}}
        assert {r.road: (r.n, r.total) for r in sums.collect()} == {j: (len(v), sum(v)) for j, v in of.items()}


def outline(rings):
    """Sides of rings (4 x m) from the middle of their box, and how far they reach from there."""
    import numpy as np

    sides = np.array([[*a, *b] for r in rings for a, b in zip(r, r[1:])], dtype=float).T
    mid = (sides[:2].min(axis=1) + sides[:2].max(axis=1)) / 2
    sides -= np.tile(mid, 2)[:, None]
    return sides, float(np.hypot(*sides[:2]).max()) + 2e-6


SQUARE = [(0, 0), (30, 0), (30, 30), (0, 30), (0, 0)]
FAR_TRIANGLE = [(200, 0), (240, 0), (240, 30), (200, 0)]


@pytest.mark.parametrize("radius", [40.0, 0.5])
@pytest.mark.parametrize("rings", ["angle with a court", [SQUARE, FAR_TRIANGLE], "points"])
def test_sums_near_long_and_short_roads_by_brute_force(rings, radius):
    import numpy as np

    from cairnfield.operators import spatial
    from cairnfield.plans.geometry_queries import OUTLINE

    rng = np.random.default_rng(5)
    x, y, value = rng.uniform(0, 3_000, 2_500), rng.uniform(0, 3_000, 2_500), rng.uniform(0, 1, 2_500)
    begin, turn, length = rng.uniform(-300, 3_300, (2, 160)), rng.uniform(0, 7, 160), 5_000 * rng.uniform(0, 1, 160) ** 2
    turn[:40], length[0] = np.round(turn[:40]) * np.pi / 2, 0.0
    roads = np.concatenate([begin, begin + length * np.stack([np.cos(turn), np.sin(turn)])])
    if rings == "points":
        tree, own = spatial.Squares(x, y, value), None
    else:
        shape, spread = outline(OUTLINE if isinstance(rings, str) else rings)
        own = np.repeat(shape[:, None, :], len(x), axis=1)
        tree = spatial.Shapes(x, y, value, own, spread)
    n, total = tree.near(roads, radius)
    for j in range(roads.shape[1]):
        road = np.repeat(roads[:, [j]], len(x), axis=1)
        d2 = spatial._segment_d2(x, y, road) if own is None else spatial._outline_d2(own + np.stack([x, y] * 2)[:, :, None], road)
        hit = d2 <= radius * radius
        assert n[j] == hit.sum() and total[j] == pytest.approx(value[hit].sum(), rel=1e-12, abs=1e-9)


def test_outlines_are_compared_around_the_ends_of_roads_only(monkeypatch):
    """A road of four times the length meets four times the polygons, but compares no more of their sides."""
    import numpy as np

    from cairnfield.operators import spatial
    from cairnfield.plans.geometry_queries import OUTLINE

    rng = np.random.default_rng(6)
    shape, spread = outline(OUTLINE)
    x, y = rng.uniform(0, 10_000, (2, 30_000))
    tree = spatial.Shapes(x, y, np.ones(len(x)), np.broadcast_to(shape[:, None, :], (4, len(x), shape.shape[1])), spread)
    seen = []

    def counted(f, places):
        return lambda *a: (seen.append(places(*a)), f(*a))[1]

    monkeypatch.setattr(spatial, "_outline_d2", counted(spatial._outline_d2, lambda e, s: s.shape[1]))
    monkeypatch.setattr(spatial.Shapes, "past", counted(getattr(spatial.Shapes, "past", None), lambda _, x, *__: len(x)), raising=False)
    work, met = [], []
    for length in (2_000.0, 8_000.0):
        turn = rng.uniform(0, np.pi, 100)
        half = np.stack([np.cos(turn), np.sin(turn)]) * length / 2
        n, _ = tree.near(np.concatenate([5_000 - half, 5_000 + half]), 40.0)
        met.append(n.sum())
        work.append(sum(seen))
        seen.clear()
    assert met[1] > 3 * met[0] and work[1] < 1.5 * work[0]


def test_outlines_are_read_from_nested_lists():
    import pyarrow as pa

    from cairnfield.operators import spatial

    ring = lambda *at: [{"x": float(a), "y": float(b)} for a, b in at]
    parts = pa.array([[[ring((0, 0), (1, 0), (0, 1), (0, 0)), ring((5, 5), (6, 6))], [ring((7, 8), (9, 9))]], None, [], [[ring((3, 3))], [ring((1, 2), (3, 4))]]])
    size, sides = spatial.outline_sides(parts)
    assert size.tolist() == [20, 0, 0, 4]
    assert sides.reshape(-1, 4).tolist() == [[0, 0, 1, 0], [1, 0, 0, 1], [0, 1, 0, 0], [5, 5, 6, 6], [7, 8, 9, 9], [1, 2, 3, 4]]


def test_lists_that_go_to_tasks_are_not_null(spark):
    """Arrow's writer passes over the rows since the last list that is not null, for each row."""
    from cairnfield.operators import spatial

    points = spark.createDataFrame([(0.0, 0.0, 1.0)], "x double, y double, v double")
    roads = spark.createDataFrame([(1, 0.0, 1.0, 9.0, 1.0)], "road int, ax double, ay double, bx double, by double")
    found = spatial.near_sums(points, roads, 2.0, "road", "v")
    assert "cast(null as array" not in found._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1.0)]


def test_road_polygons_makes_no_pairs(spark, monkeypatch):
    from cairnfield.operators import spatial
    from cairnfield.plans import geometry_queries

    def pairs(*_, **__):
        raise AssertionError("pairs of buildings and roads were made")

    monkeypatch.setattr(spatial, "near_polygons", pairs)
    assert geometry_queries.road_polygons(spark, "/root/testdata/sf0.001").count()


def test_no_table_of_the_outlines_is_broadcast(spark, monkeypatch):
    """Rounds of the labelling and of the rings, and the join behind them: what they write comes from shuffles."""
    from cairnfield.operators import iterate, labelling
    from cairnfield.plans import geometry_queries

    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return iterate.kept(df)

    monkeypatch.setattr(labelling, "kept", watched)
    found = geometry_queries.component_points(spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
