"""Connected components of label masks, and their outlines as polygons.

Masks are cut into square blocks. What lies inside a block is settled there; only the borders of
blocks meet in joins, and what is left is a graph of the few labels that touch them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.operators.iterate import dealt, kept, released, same
from cairnfield.sources import geometry
from cairnfield.sources.files import ship

#: Pixels along a block's side; a block is one row with its pixels' places.
BLOCK = 256
#: Directions along a pixel's sides, the pixel on the right hand on screen: right, down, left, up.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 with edges (a, b): the smallest node that each is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            return label
        label = after


def roots_of(cells: np.ndarray, side: int, connectivity: int) -> np.ndarray:
    """Of a block's places (row * side + column, sorted): the first place of each one's component."""
    index = np.full((side + 1) * (side + 2), -1)
    spot = (cells // side) * (side + 2) + cells % side + 1  # a column of nothing on both sides
    index[spot] = np.arange(len(cells))
    a, b = [], []
    for step in (1, side + 2, side + 1, side + 3)[: 4 if connectivity == 8 else 2]:
        other = index[np.minimum(spot + step, len(index) - 1)]
        a.append(np.flatnonzero(other >= 0))
        b.append(other[other >= 0])
    return cells[least_labels(len(cells), np.concatenate(a), np.concatenate(b))]


def _blocks(mask: DataFrame, side: int) -> DataFrame:
    """(tile_id, by, bx, cells): the places of each block's pixels, sorted; repeated pixels count once."""
    at = (F.col("row") % side * side + F.col("col") % side).cast("int")
    placed = mask.select("tile_id", F.floor(F.col("row") / side).cast("long").alias("by"), F.floor(F.col("col") / side).cast("long").alias("bx"), at.alias("at"))
    return placed.groupBy("tile_id", "by", "bx").agg(F.sort_array(F.collect_set("at")).alias("cells"))  # side * side at most


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0), kind))


def _labelled(mask: DataFrame, connectivity: int, width: int, side: int) -> DataFrame:
    """(tile_id, by, bx, cells, components): ``components`` has the number of the first pixel of each cell's component."""
    ship(mask.sparkSession)

    @F.arrow_udf("array<int>")
    def local(cells: pa.Array) -> pa.Array:
        return _lists([roots_of(c.values.to_numpy(), side, connectivity) for c in cells], pa.int32())

    blocks = kept(_blocks(mask, side).withColumn("roots", local("cells")))

    def number(place: Column) -> Column:
        row = F.col("by") * side + F.floor(place / side)
        return (row * width + F.col("bx") * side + place % side).cast("long")

    # where blocks touch: (row, col, label) along their borders, and the steps that lead into another block
    inner = (F.col("c.cells") % side).between(1, side - 2) & F.floor(F.col("c.cells") / side).between(1, side - 2)
    border = blocks.select("tile_id", "by", "bx", F.explode(F.arrays_zip("cells", "roots")).alias("c")).where(~inner)
    border = border.select("tile_id", "by", "bx", (F.col("by") * side + F.floor(F.col("c.cells") / side)).alias("row"), (F.col("bx") * side + F.col("c.cells") % side).alias("col"), number(F.col("c.roots")).alias("label"))
    steps = ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if connectivity == 8 else 2]
    ahead = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in steps])
    out = border.select("tile_id", "by", "bx", F.col("label").alias("a"), F.explode(ahead).alias("to")).where((F.floor(F.col("to.row") / side) != F.col("by")) | (F.floor(F.col("to.col") / side) != F.col("bx")))
    edges = out.select("tile_id", "a", "to.row", "to.col").join(dealt(border.select("tile_id", "row", "col", F.col("label").alias("b"))), ["tile_id", "row", "col"]).select("tile_id", "a", "b").distinct()

    top = _contracted(edges)
    place = F.floor(F.col("label") / width) % side * side + F.col("label") % width % side
    moved = top.where("label <> top").select("tile_id", F.floor(F.col("label") / width / side).alias("by"), F.floor(F.col("label") % width / side).alias("bx"), F.struct(place.cast("int").alias("root"), "top").alias("m"))
    moved = moved.groupBy("tile_id", "by", "bx").agg(F.sort_array(F.collect_list("m")).alias("moved"))  # labels on a block's border

    @F.arrow_udf("array<bigint>")
    def settled(roots: pa.Array, by: pa.Array, bx: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
        out = []
        for r, y, x, o, n in zip(roots, by.to_pylist(), bx.to_pylist(), old, new, strict=True):
            places = r.values.to_numpy().astype(np.int64)
            label = (y * side + places // side) * width + x * side + places % side
            if o.is_valid and len(o.values):
                known, tops = o.values.to_numpy(), n.values.to_numpy()
                at = np.minimum(np.searchsorted(known, places), len(known) - 1)
                label = np.where(known[at] == places, tops[at], label)
            out.append(label)
        return _lists(out, pa.int64())

    joined = blocks.join(dealt(moved), ["tile_id", "by", "bx"], "left")
    return joined.select("tile_id", "by", "bx", "cells", settled("roots", "by", "bx", F.col("moved.root"), F.col("moved.top")).alias("components"))


def _contracted(edges: DataFrame) -> DataFrame:
    """(tile_id, label, top): the smallest label that each label of ``edges`` (tile_id, a, b) is linked to.

    A round takes the least among a label and its neighbours, and then that one's own.
    """
    both = kept(edges.union(edges.select("tile_id", "b", "a")).distinct())
    now = kept(both.groupBy("tile_id", F.col("a").alias("label")).agg(F.min("b").alias("b")).select("tile_id", "label", F.least("label", "b").alias("top")))
    while True:
        near = now.select("tile_id", F.col("label").alias("b"), F.col("top").alias("near"))
        least = both.join(dealt(near), ["tile_id", "b"]).groupBy("tile_id", F.col("a").alias("label")).agg(F.min("near").alias("near"))
        lower = now.join(dealt(least), ["tile_id", "label"]).select("tile_id", "label", F.least("top", "near").alias("top"))
        above = lower.select("tile_id", F.col("label").alias("top"), F.col("top").alias("above"))
        after = kept(lower.join(dealt(above), ["tile_id", "top"]).select("tile_id", "label", F.col("above").alias("top")))
        done = same(now, after, "top")
        released(now)
        now = after
        if done:
            released(both)
            return now


def connected_components(mask: DataFrame, connectivity: int = 8, width: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """(tile_id, row, col, component) of foreground pixels (tile_id, row, col): the raster number of its first pixel.

    Labels are found within blocks; then only labels that touch a block's border are joined. Tiles
    are never gathered in one task. ``width`` is more than any column number; rows and columns start from 0.
    """
    found = _labelled(mask, connectivity, width, block)
    pixels = found.select("tile_id", "by", "bx", F.explode(F.arrays_zip("cells", "components")).alias("c"))
    row = F.col("by") * block + F.floor(F.col("c.cells") / block)
    col = F.col("bx") * block + F.col("c.cells") % block
    types = dict(mask.dtypes)
    return pixels.select("tile_id", row.cast(types["row"]).alias("row"), col.cast(types["col"]).alias("col"), F.col("c.components").alias("component"))


# outlines


def boundary_edges(mask: DataFrame, width: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """(tile_id, part, x, y, way): unit edges between a pixel and the outside, from (x, y) one step along STEPS[way].

    Parts are components of pixels that share sides. Edges on a block's border are set from both sides and cancel.
    """
    found = _labelled(mask, 4, width, block)

    @F.arrow_udf("array<struct<part: bigint, at: int, way: int, border: boolean>>")
    def open_sides(cells: pa.Array, parts: pa.Array) -> pa.Array:
        out, sizes = [], []
        for c, p in zip(cells, parts, strict=True):
            places, part = c.values.to_numpy(), p.values.to_numpy()
            row, col = places // block, places % block
            grid = np.zeros((block + 2, block + 2), dtype=bool)
            grid[row + 1, col + 1] = True
            n = 0
            for way, (dy, dx) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1))):
                free = ~grid[row + 1 + dy, col + 1 + dx]
                edge = (row + dy < 0) | (row + dy >= block) | (col + dx < 0) | (col + dx >= block)
                out.append((part[free], places[free], np.full(free.sum(), way), edge[free]))
                n += int(free.sum())
            sizes.append(n)
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(4)]
        entries = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["part", "at", "way", "border"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), entries)

    e = found.select("tile_id", "by", "bx", F.explode(open_sides("cells", "components")).alias("e")).select("tile_id", "by", "bx", "e.*")
    row, col = F.col("by") * block + F.floor(F.col("at") / block), F.col("bx") * block + F.col("at") % block
    way = F.col("way")
    x = col + F.when(way.isin(1, 2), 1).otherwise(0)
    y = row + F.when(way.isin(2, 3), 1).otherwise(0)
    edges = e.select("tile_id", "part", x.cast("long").alias("x"), y.cast("long").alias("y"), "way", "border")
    # a side that two pixels share is walked once each way
    x0 = F.when(way == 2, F.col("x") - 1).otherwise(F.col("x"))
    y0 = F.when(way == 3, F.col("y") - 1).otherwise(F.col("y"))
    once = edges.where("border").groupBy("tile_id", x0.alias("x0"), y0.alias("y0"), (way % 2).alias("flat")).agg(F.count("*").alias("n"), F.first(F.struct("part", "x", "y", "way")).alias("e")).where("n = 1")
    return edges.where("NOT border").drop("border").union(once.select("tile_id", "e.part", "e.x", "e.y", "e.way"))


def segments(edges: DataFrame) -> DataFrame:
    """(tile_id, part, id, way, x, y, x2, y2): the longest straight runs of unit edges. ``id`` is one of its tile's."""
    way = F.col("way")
    flat = way % 2 == 0
    line, along = F.when(flat, F.col("y")).otherwise(F.col("x")), F.when(flat, F.col("x")).otherwise(F.col("y"))
    key = ["tile_id", "part", "way", "line"]
    placed = edges.withColumns({"line": line, "along": along})
    island = F.col("along") - F.row_number().over(Window.partitionBy(*key).orderBy("along"))
    runs = placed.withColumn("island", island).groupBy(*key, "island").agg(F.min("along").alias("first"), F.max("along").alias("last"))
    forward = way < 2
    start, end = F.when(forward, F.col("first")).otherwise(F.col("last")), F.when(forward, F.col("last") + 1).otherwise(F.col("first") - 1)
    ends = {"x": F.when(flat, start).otherwise(F.col("line")), "y": F.when(flat, F.col("line")).otherwise(start), "x2": F.when(flat, end).otherwise(F.col("line")), "y2": F.when(flat, F.col("line")).otherwise(end)}
    rows = runs.select("tile_id", "part", "way", *[v.alias(k) for k, v in ends.items()])
    return rows.withColumn("id", (F.col("y") * (1 << 31) + F.col("x")) * 4 + way)


def rings(mask: DataFrame, width: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """(tile_id, part, ring, area, vertices): closed outlines; the outer ring of a part has a positive area, holes a negative.

    Corners follow one another by a join; which ring they belong to and their place in it come from
    jumps that double, over corners only. Where two pixels of a part touch at a corner alone,
    the outline stays with the outside pixel, so holes that touch the rim are rings of their own.
    """
    s = kept(segments(boundary_edges(mask, width, block)))
    key = ["tile_id", "part"]
    after = s.select(*key, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("id").alias("next"), F.col("way").alias("turn"))
    inward = F.col("turn") == (F.col("way") + 3) % 4
    nexts = s.join(dealt(after), [*key, "x2", "y2"]).groupBy("tile_id", "id").agg(F.max_by("next", F.when(inward, 1).otherwise(0)).alias("next"))

    jumps = kept(nexts.withColumn("least", F.least("id", "next")))
    while True:  # the least corner among the next 2, 4, 16, ...
        further = jumps
        for _ in range(2):
            to = further.select("tile_id", F.col("id").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
            further = further.join(dealt(to), ["tile_id", "next"]).select("tile_id", "id", F.col("next2").alias("next"), F.least("least", "least2").alias("least"))
        further = kept(further)
        done = same(jumps, further, "least")
        released(jumps)
        jumps = further
        if done:
            break
    # steps to the end of each ring, which is cut before its least corner
    begin = kept(nexts.join(dealt(jumps.select("tile_id", "id", "least")), ["tile_id", "id"]))
    released(jumps)
    steps = begin.select("tile_id", "id", "least", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("least"), 1).otherwise(0).cast("long").alias("left"))
    while steps.where("next IS NOT NULL").limit(1).count():
        before = steps
        for _ in range(2):
            to = steps.select("tile_id", F.col("id").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
            steps = steps.join(dealt(to), ["tile_id", "next"], "left").select("tile_id", "id", "least", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"))
        steps = kept(steps)
        released(before)
    placed = steps.join(dealt(s), ["tile_id", "id"])
    corner = F.struct((-F.col("left")).alias("k"), geometry.vertex(F.col("x"), F.col("y")).alias("p"))
    cross = (F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2
    closed = placed.groupBy("tile_id", "part", F.col("least").alias("ring")).agg(F.sum(cross).alias("area"), F.sort_array(F.collect_list(corner)).alias("all"))
    vertices = F.transform(F.concat("all", F.slice("all", 1, 1)), lambda c: c["p"])
    return closed.select("tile_id", "part", "ring", "area", vertices.alias("vertices"))


def polygonise(mask: DataFrame, width: int = 1 << 20, block: int = BLOCK, affine: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0), connectivity: int = 8) -> DataFrame:
    """(tile_id, component, pixel_count, n_holes, geometry) of each component: a polygon of every part that shares sides.

    ``affine`` is left, pixel width, top and pixel height (negative where rows run down the map).
    A hole belongs to the polygon of its own part, so no search is needed to place it.
    """
    pixels = mask.select("tile_id", "row", "col")
    whole = kept(connected_components(pixels, connectivity, width, block))
    left, sx, top, sy = affine
    at = lambda p: geometry.vertex(F.lit(left) + p["x"] * sx, F.lit(top) + p["y"] * sy)
    ring = F.struct((F.col("area") < 0).alias("hole"), "ring", F.transform("vertices", at).alias("v"))
    parts = rings(pixels, width, block).groupBy("tile_id", "part").agg(F.sort_array(F.collect_list(ring)).alias("rings"))
    first = whole.select("tile_id", (F.col("row").cast("long") * width + F.col("col")).alias("part"), "component")
    owned = parts.join(dealt(first), ["tile_id", "part"])
    one = F.struct("part", F.transform("rings", lambda r: r["v"]).alias("rings"), (F.size("rings") - 1).cast("long").alias("holes"))
    found = owned.groupBy("tile_id", "component").agg(F.sort_array(F.collect_list(one)).alias("parts"), F.sum(F.size("rings") - 1).alias("n_holes"))
    size = whole.groupBy("tile_id", "component").agg(F.count("*").alias("pixel_count"))
    kind = F.when(F.size("parts") == 1, geometry.POLYGON).otherwise(geometry.POLYGONS)
    shape = F.struct(kind.alias("kind"), F.transform("parts", lambda p: p["rings"]).alias("parts")).cast(geometry.GEOMETRY)
    return found.join(dealt(size), ["tile_id", "component"]).select("tile_id", "component", "pixel_count", "n_holes", shape.alias("geometry"))


def component_boxes(components: DataFrame, size: float = 1.0) -> DataFrame:
    """Pixel count, bounding box and mean position of each component, in map units of ``size``."""
    return components.groupBy("tile_id", "component").agg(
        F.count("*").alias("pixel_count"),
        (F.min("col") * size).alias("minx"),
        (F.min("row") * size).alias("miny"),
        ((F.max("col") + 1) * size).alias("maxx"),
        ((F.max("row") + 1) * size).alias("maxy"),
        ((F.avg("col") + 0.5) * size).alias("x"),
        ((F.avg("row") + 0.5) * size).alias("y"),
    )


def component_runs(components: DataFrame, size: float = 1.0) -> DataFrame:
    """The exact area of each component as boxes, one for each run of pixels in a row.

    Together the boxes of a component are its polygon set, in map units of ``size``.
    """
    key = ["tile_id", "component", "row"]
    placed = components.withColumn("__island", F.col("col") - F.row_number().over(Window.partitionBy(*key).orderBy("col")))
    runs = placed.groupBy(*key, "__island").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    return runs.select(
        "tile_id",
        "component",
        (F.col("first") * size).alias("minx"),
        (F.col("row") * size).alias("miny"),
        ((F.col("last") + 1) * size).alias("maxx"),
        ((F.col("row") + 1) * size).alias("maxy"),
    )
