"""The road graph: risk of roads, edges, shortest paths from facilities, accessibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators import order as ordered
from cairnfield.operators.iterate import kept
from cairnfield.operators.paths import distances
from cairnfield.operators.scalars import with_scalars
from cairnfield.operators.spatial import near_sums


__all__ = ["accessibility", "distances", "edges", "length", "road_risk", "segments", "usable_lines"]


def usable_lines(roads: DataFrame, coords: str = "coords") -> DataFrame:
    """Lines with at least two vertices and some length; ``coords`` is an array of (x, y)."""
    return roads.where(F.size(coords) >= 2).where(F.exists(F.col(coords), lambda p: (p["x"] != F.col(coords)[0]["x"]) | (p["y"] != F.col(coords)[0]["y"])))


def segments(roads: DataFrame, coords: str = "coords") -> DataFrame:
    """Consecutive vertex pairs of each line: place, ax, ay, bx, by; pairs without length go."""
    n = F.size(coords)
    pairs = F.arrays_zip(F.slice(coords, F.lit(1), n - 1).alias("a"), F.slice(coords, F.lit(2), n - 1).alias("b"))
    rows = roads.where(n >= 2).select(*[c for c in roads.columns if c != coords], F.posexplode(pairs).alias("place", "pair"))
    ends = [F.col(f"pair.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"]
    return rows.select("*", *ends).drop("pair").where("ax <> bx OR ay <> by")


def length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def road_risk(roads: DataFrame, buildings: DataFrame, radius: float = 125.0, lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """Add density and estimated_risk to straight roads (road_id, ax, ay, bx, by).

    density: expected destroyed buildings within ``radius`` per square kilometre of the buffer;
    estimated_risk: the density between two exact quantiles of all roads.
    """
    roads = roads.withColumn("length", length(*[F.col(c) for c in ("ax", "ay", "bx", "by")])).where("length > 0")
    found = near_sums(buildings.select("x", "y", "p_destroyed"), roads.select("road_id", "ax", "ay", "bx", "by"), radius, "road_id", "p_destroyed")
    hit = found.select("road_id", F.col("total").alias("destroyed"))
    area = F.greatest(F.col("length") * (2 * radius / 1_000_000), F.lit(1e-6))
    dense = roads.join(hit, "road_id", "left").withColumn("density", F.coalesce("destroyed", F.lit(0.0)) / area).drop("destroyed")
    dense = kept(dense)  # used twice below, and the join behind it is the costly part
    limits = ordered.quantiles(dense, {"__lo": (F.col("density"), lower), "__hi": (F.col("density"), upper)})
    return with_scalars(dense, limits).withColumn("estimated_risk", C.robust_scaled(F.col("density"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def edges(risk_roads: DataFrame, multiplier: float = 4.0, order: str = "road_id") -> DataFrame:
    """Undirected edges between node positions rounded to millimetres: u, v, normal_cost, risk_cost.

    Of parallel edges the shortest stays, and the first of equally short ones.
    """
    a = F.struct(F.round("ax", 3).alias("x"), F.round("ay", 3).alias("y"))
    b = F.struct(F.round("bx", 3).alias("x"), F.round("by", 3).alias("y"))
    rows = risk_roads.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col("length").alias("normal_cost"), (F.col("length") * (1 + multiplier * F.col("estimated_risk"))).alias("risk_cost"), "estimated_risk", F.col(order).alias("edge_id"))
    best = F.min_by(F.struct("normal_cost", "risk_cost", "estimated_risk", "edge_id"), F.struct("normal_cost", "edge_id"))
    return rows.where("normal_cost > 0 AND u <> v").groupBy("u", "v").agg(best.alias("e")).select("u", "v", "e.*")


#: The status of a cell.
AT_RISK, ISOLATED = "estimated accessibility risk", "estimated isolation under current risk model"


def accessibility(cells: DataFrame, normal: DataFrame, adjusted: DataFrame, node: str = "node") -> DataFrame:
    """Costs, penalty in [0, 1] and status of cells with their nearest node.

    A cell whose node can't be reached, or is a facility itself (cost 0), counts as isolated.
    """
    rows = cells.join(normal.select(node, F.col("cost").alias("__base")), node, "left").join(adjusted.select(node, F.col("cost").alias("__risk")), node, "left")
    base, risk = F.col("__base"), F.col("__risk")
    fine = base.isNotNull() & risk.isNotNull() & (base > 0)
    return rows.select(
        *cells.columns,
        F.when(fine, base).alias("normal_facility_cost_m"),
        F.when(fine, risk).alias("risk_adjusted_facility_cost_m"),
        C.accessibility_penalty(base, risk).alias("accessibility_penalty"),
        F.when(fine, AT_RISK).otherwise(ISOLATED).alias("accessibility_status"),
    )
