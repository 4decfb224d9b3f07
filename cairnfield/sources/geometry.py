"""Geometry tables: WKB columns in Parquet, boxes beside them, and reads that skip what lies elsewhere.

A geometry is a struct of its kind (1 point, 2 line, 3 polygon, 4 to 6 several of these) and its parts:
each part is a list of rings (points and lines have one), each ring a list of (x, y). Tables
hold the standard binary form and a ``bbox`` of four doubles, and lie in Z-order of the boxes'
centres, so that a row group covers a small area and a box query skips the others by their statistics.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.sources import files
from cairnfield.sources.files import ship

POINT, LINE, POLYGON, POINTS, LINES, POLYGONS = range(1, 7)
#: Names of the kinds in a table's description.
NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
VERTEX = "struct<x: double, y: double>"
GEOMETRY = f"struct<kind: int, parts: array<array<array<{VERTEX}>>>>"
BOX = ("xmin", "ymin", "xmax", "ymax")
Box = tuple[float, float, float, float]
#: Bits of each axis in the order of a table's rows, and bytes of a row group.
ORDER_BITS, ROW_GROUP = 16, 16 << 20


# made of columns


def _of(kind: int, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts")).cast(GEOMETRY)


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    return _of(POINT, F.array(F.array(F.array(vertex(x, y)))))


def line(vertices: Column) -> Column:
    return _of(LINE, F.array(F.array(vertices)))


def polygon(rings: Column) -> Column:
    """Of an array of rings, the outer one first; rings end where they begin."""
    return _of(POLYGON, F.array(rings))


def polygons(parts: Column) -> Column:
    return _of(POLYGONS, parts)


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return polygon(F.array(F.array(*[vertex(x, y) for x, y in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))])))


def bbox(geometry: Column) -> Column:
    """The least box around a geometry; null where it has no vertex."""
    at = F.flatten(F.flatten(geometry["parts"]))
    ends = [F.array_min(F.transform(at, lambda p: p["x"])), F.array_min(F.transform(at, lambda p: p["y"])), F.array_max(F.transform(at, lambda p: p["x"])), F.array_max(F.transform(at, lambda p: p["y"]))]
    return F.when(F.size(at) > 0, F.struct(*[e.alias(n) for e, n in zip(ends, BOX, strict=True)]))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring: positive if it runs counter-clockwise."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def area(geometry: Column) -> Column:
    """Of polygons: outer rings less their holes, however the rings run. Other kinds have none."""
    one = lambda rings: F.aggregate(rings, F.lit(0.0), lambda s, r: F.when(s == 0.0, F.abs(ring_area(r))).otherwise(s - F.abs(ring_area(r))))
    total = F.aggregate(F.transform(geometry["parts"], one), F.lit(0.0), lambda s, v: s + v)
    return F.when(geometry["kind"].isin(POLYGON, POLYGONS), total).otherwise(F.when(geometry["kind"].isNotNull(), F.lit(0.0)))


def interior_point(shape: Column) -> Column:
    """A point inside of polygons: the middle of the widest piece of a line across them; null for other kinds.

    The line runs level, half-way between two heights of vertices, as near to the middle of the box as such a pair lies.
    """
    rings = F.flatten(shape["parts"])
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    n = F.size(heights)
    middle = (F.element_at(heights, 1) + F.element_at(heights, -1)) / 2
    lines = F.zip_with(F.slice(heights, F.lit(1), n - 1), F.slice(heights, F.lit(2), n - 1), lambda a, b: (a + b) / 2)
    level = F.array_min(F.transform(lines, lambda y: F.struct(F.abs(y - middle).alias("off"), y.alias("y"))))["y"]

    def pieces(y: Column) -> Column:
        def crossings(ring: Column) -> Column:
            m = F.size(ring) - 1
            ends = F.zip_with(F.slice(ring, F.lit(1), m), F.slice(ring, F.lit(2), m), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            cut = F.filter(ends, lambda e: (e["a"]["y"] < y) != (e["b"]["y"] < y))
            return F.transform(cut, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))

        x = F.array_sort(F.flatten(F.transform(rings, crossings)))
        return _let(x, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda k: F.struct((F.get(v, 2 * k + 1) - F.get(v, 2 * k)).alias("wide"), (-F.get(v, 2 * k)).alias("first"), vertex((F.get(v, 2 * k) + F.get(v, 2 * k + 1)) / 2, y).alias("p"))))

    inside = _let(level, lambda y: F.array_max(pieces(y))["p"])
    return F.when(shape["kind"].isin(POLYGON, POLYGONS) & (n > 1), inside)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# the binary form


def _rows(data: bytes, at: int) -> tuple[int, list[list[np.ndarray]], int]:
    """Kind, parts and end of the geometry at ``at``; heights and measures are left out."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if code & 0x20000000:  # a reference system's number
        at += 4
    flat = code & 0x1FFFFFFF
    kind = flat % 1000
    wide = 2 + (2 if flat // 1000 == 3 else 1 if flat >= 1000 else 0) + bool(code & 0x80000000) + bool(code & 0x40000000)
    if not POINT <= kind <= POLYGONS:
        raise ValueError(f"WKB of kind {kind} is not read")

    def run(n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, order + "f8", n * wide, at).reshape(n, wide)[:, :2]
        at += 8 * n * wide
        return out

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    if kind == POINT:
        p = run(1)
        return kind, [[p]] if not np.isnan(p).all() else [], at
    if kind == LINE:
        return kind, [[run(count())]], at
    if kind == POLYGON:
        return kind, [[run(count()) for _ in range(count())]], at
    parts = []
    for _ in range(count()):
        _, inner, at = _rows(data, at)
        parts += inner
    return kind, parts, at


def decoded(column: pa.Array) -> pa.Array:
    """Geometries of a binary column."""
    kinds, vertices, rings, parts, rows = [], [], [0], [0], [0]
    for value in column:
        if not value.is_valid:
            kinds.append(None)
        else:
            kind, found, _ = _rows(value.as_py(), 0)
            kinds.append(kind)
            for part in found:
                for ring in part:
                    vertices.append(ring)
                    rings.append(rings[-1] + len(ring))
                parts.append(len(rings) - 1)
        rows.append(len(parts) - 1)
    xy = np.concatenate(vertices) if vertices else np.zeros((0, 2))
    at = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, i], dtype=np.float64)) for i in (0, 1)], ["x", "y"])
    for ends in (rings, parts, rows):
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.int32()), at], ["kind", "parts"], mask=pa.array([k is None for k in kinds]))


def encoded(column: pa.Array) -> pa.Array:
    """The binary form of geometries, little-endian."""
    out: list[bytes | None] = []
    head = lambda kind: struct.pack("<BI", 1, kind)

    def body(kind: int, rings: list[bytes]) -> bytes:
        sized = [struct.pack("<I", len(r) // 16) + r for r in rings]
        if kind == POINT:
            return head(kind) + (rings[0] if rings else struct.pack("<2d", np.nan, np.nan))
        return head(kind) + (sized[0] if sized else struct.pack("<I", 0)) if kind == LINE else head(kind) + struct.pack("<I", len(sized)) + b"".join(sized)

    parts = column.field("parts")
    polygons_, vertices = parts.values, parts.values.values.values
    xy = np.stack([vertices.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1) if len(vertices) else np.zeros((0, 2))
    rows, in_parts, in_rings = (np.asarray(a.offsets) for a in (parts, polygons_, polygons_.values))
    kinds, valid = column.field("kind").to_pylist(), column.is_valid().to_pylist()
    for i, (kind, given) in enumerate(zip(kinds, valid, strict=True)):
        if not given or kind is None:
            out.append(None)
            continue
        bodies = [[xy[in_rings[r] : in_rings[r + 1]].tobytes() for r in range(in_parts[p], in_parts[p + 1])] for p in range(rows[i], rows[i + 1])]
        if kind >= POINTS:
            out.append(head(kind) + struct.pack("<I", len(bodies)) + b"".join(body(kind - 3, b) for b in bodies))
        else:
            out.append(body(kind, bodies[0] if bodies else []))
    return pa.array(out, pa.binary())


def from_wkb(spark: SparkSession, column: Column | str) -> Column:
    """Geometry of a WKB column; kinds beyond simple ones are errors."""
    ship(spark)
    return F.arrow_udf(decoded, GEOMETRY)(column)


def to_wkb(spark: SparkSession, column: Column | str) -> Column:
    ship(spark)
    return F.arrow_udf(encoded, "binary")(column)


# tables


def z_order(x: Column, y: Column, extent: Box, bits: int = ORDER_BITS) -> Column:
    """The bits of a place's two coordinates within ``extent``, one by one in turn."""

    def whole(v: Column, low: float, high: float) -> Column:
        step = (v - low) / (max(high - low, 1e-300) / ((1 << bits) - 1))
        return F.least(F.greatest(F.floor(step), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
        return v

    return spread(whole(x, extent[0], extent[2])).bitwiseOR(F.shiftleft(spread(whole(y, extent[1], extent[3])), 1))


def write_geometries(rows: DataFrame, path: str, crs: str | None, geometry: str = "geometry", row_group: int = ROW_GROUP) -> None:
    """Rows as a geometry table: ``geometry`` in binary form, its ``bbox``, in Z-order, with ``crs`` in its description.

    Rows without a geometry, or with an empty one, have no box, lie last and are never in a box query.
    """
    spark = rows.sparkSession
    boxed = rows.withColumn("bbox", bbox(F.col(geometry)))
    middle = [(F.col(f"bbox.{a}min") + F.col(f"bbox.{a}max")) / 2 for a in "xy"]
    r = boxed.agg(*[f(m) for f in (F.min, F.max) for m in middle], F.array_sort(F.collect_set(F.col(geometry)["kind"]))).first()
    extent = (0.0, 0.0, 1.0, 1.0) if r[0] is None else (r[0], r[1], r[2], r[3])
    place = F.coalesce(z_order(*middle, extent), F.lit(1 << 40))
    binary = boxed.withColumn("__z", place).withColumn(geometry, to_wkb(spark, geometry))
    about = {"encoding": "WKB", "geometry_types": [NAMES[k - 1] for k in r[4]], "crs": crs, "covering": {"bbox": {n: ["bbox", n] for n in BOX}}}
    named = F.col(geometry).alias(geometry, metadata={"geo": json.dumps(about)})
    dealt = binary.repartitionByRange("__z").sortWithinPartitions("__z")
    dealt.select(*[named if c == geometry else F.col(f"`{c}`") for c in boxed.columns]).write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)
    system, inner = files.store(path)
    with system.open_output_stream(f"{inner.rstrip('/')}/_geo.json") as out:  # readers pass it by
        out.write(json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: about}}).encode())


def read_geometries(spark: SparkSession, path: str, within: Box | None = None, geometry: str = "geometry", decode: bool = True) -> DataFrame:
    """A geometry table; with ``within`` only rows whose box meets it, and row groups that can't hold such are not read."""
    rows = spark.read.parquet(path)
    if within is not None:
        x0, y0, x1, y1 = within
        rows = rows.where((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))
    if not decode:
        return rows
    kept = rows.schema[geometry].metadata
    return rows.withColumn(geometry, from_wkb(spark, geometry)).withMetadata(geometry, kept)


def crs_of(rows: DataFrame, geometry: str = "geometry") -> str | None:
    """The reference system in a geometry column's description."""
    about = rows.schema[geometry].metadata.get("geo")
    return json.loads(about)["crs"] if about else None


def require_same_crs(*frames: DataFrame, geometry: str = "geometry") -> str:
    """The one reference system of all frames; an absent or a different one is an error."""
    found = {crs_of(f, geometry) for f in frames}
    if None in found:
        raise ValueError("A geometry table has no reference system")
    if len(found) != 1:
        raise ValueError(f"Reference systems differ: {', '.join(sorted(found))}")
    return found.pop()
