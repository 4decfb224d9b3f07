"""Leakage-safe splits, samplers and the checks on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import columns as C


def hashed_rank(rows: DataFrame, group: str, digest: Column, tie: str, out: str = "rank") -> DataFrame:
    """Number rows 1, 2, .. within each group in order of a hexadecimal digest (then ``tie``).

    The digest's first two digits cut each group into 256 slices that are numbered on their own
    and shifted by the sizes of the slices before them, so a large group is never one task.
    """
    cut = rows.withColumns({"__digest": digest, "__slice": F.substring(digest, 1, 2)})
    sizes = cut.groupBy(group, "__slice").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__size")
    order = Window.partitionBy(group, "__slice").orderBy("__digest", tie)
    ranked = cut.withColumn("__n", F.row_number().over(order)).join(shifts, [group, "__slice"])
    return ranked.withColumn(out, F.col("__n") + F.col("__before")).drop("__digest", "__slice", "__n", "__before")


def holdout_split(tiles: DataFrame, val_events: list, test_events: list, train_events: list | None = None) -> DataFrame:
    """Add partition by event. Fails on events in two lists, unknown events and empty partitions."""
    lists = {"val": set(val_events), "test": set(test_events)} | ({"train": set(train_events)} if train_events is not None else {})
    names = list(lists)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if lists[a] & lists[b]:
                raise ValueError(f"Event leakage: {sorted(lists[a] & lists[b])}")
    wanted = set().union(*lists.values())
    known = {r[0] for r in tiles.where(F.col("event_id").isin(*wanted)).select("event_id").distinct().collect()}
    if wanted - known:
        raise ValueError(f"Unknown events: {sorted(wanted - known)}")
    if any(not v for v in lists.values()):
        raise ValueError("A partition is empty")
    event = F.col("event_id")
    partition = F.when(event.isin(*val_events), "val").when(event.isin(*test_events), "test")
    partition = partition.when(event.isin(*train_events), "train") if train_events is not None else partition.otherwise("train")
    return tiles.withColumn("partition", partition).where("partition IS NOT NULL")


def validation_event(tiles: DataFrame, test_event: str, first: bool = False) -> str:
    """Of the events but the test event, the last in order, or the first."""
    rest = tiles.where(F.col("event_id") != test_event)
    return rest.agg((F.min if first else F.max)("event_id")).first()[0]


def standard_split(tiles: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Add partition, stratified by event: each event's tiles in a seeded order, cut at rounded shares."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("tile_id")))
    ranked = hashed_rank(tiles, "event_id", digest, "tile_id", "__rank")
    sizes = tiles.groupBy("event_id").agg(F.count("*").alias("__n"))
    n = F.col("__n")
    n_train = F.when(n < 3, 1).otherwise(F.least(n - 2, F.greatest(F.lit(1), F.bround(n * train, 0).cast("long"))))
    n_val = F.when(n < 3, 0).otherwise(F.least(n - n_train - 1, F.greatest(F.lit(1), F.bround(n * val, 0).cast("long"))))
    rows = ranked.join(sizes, "event_id").withColumns({"__train": n_train, "__val": n_val})
    part = F.when(F.col("__rank") <= F.col("__train"), "train").when(F.col("__rank") <= F.col("__train") + F.col("__val"), "val").otherwise("test")
    split = rows.withColumn("partition", part).drop("__rank", "__n", "__train", "__val")
    return _filled(split)


def _filled(split: DataFrame) -> DataFrame:
    """Give an empty validation or test partition the last tile of the largest one."""
    for target in ("val", "test"):
        sizes = {r["partition"]: r["count"] for r in split.groupBy("partition").count().collect()}
        if not sizes or sizes.get(target):
            continue
        donor = max((p for p in ("train", "val", "test") if p != target), key=lambda p: sizes.get(p, 0))
        if sizes.get(donor, 0) <= 1:
            raise ValueError("At least three tiles are required for a standard split")
        last = split.where(F.col("partition") == donor).agg(F.max(F.struct("event_id", "tile_id")).alias("m")).first()["m"]["tile_id"]
        split = split.withColumn("partition", F.when(F.col("tile_id") == last, target).otherwise(F.col("partition")))
    return split


def official_split(tiles: DataFrame, ids: dict[str, DataFrame], key: str = "tile_id") -> DataFrame:
    """Add partition from id lists, which must not share ids and must be known; events may repeat."""
    named = None
    for name, df in ids.items():
        part = df.select(F.trim(F.col(key)).alias(key), F.lit(name).alias("partition")).where(F.col(key) != "")
        named = part if named is None else named.union(part)
    shared = named.groupBy(key).agg(F.count_distinct("partition").alias("n")).where("n > 1")
    if shared.limit(1).count():
        raise ValueError("Tile leakage between official partitions")
    if named.join(tiles, key, "left_anti").limit(1).count():
        raise ValueError("Official split names unknown tiles")
    return tiles.join(named.distinct(), key)


def unknown_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def leakage(split: DataFrame, unit: str = "event_id") -> DataFrame:
    """Units in more than one partition, with the partitions."""
    parts = F.array_sort(F.collect_set("partition"))
    return split.groupBy(unit).agg(parts.alias("p")).where(F.size("p") > 1).select(unit, F.array_join("p", ",").alias("partitions"))


def balanced_sample(tiles: DataFrame, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``size`` draws with replacement: a uniform event, then a uniform tile of it.

    Draws are numbered, and depend on the seed, the epoch and their number only.
    """
    tag = f"{seed + epoch}"
    events = tiles.groupBy("event_id").agg(F.count("*").alias("n"))
    n_events = events.count()
    order = Window.orderBy("event_id")  # events are few, this is a dimension table
    events = events.withColumn("e", F.row_number().over(order) - 1)
    ranked = hashed_rank(tiles, "event_id", F.md5(F.concat(F.lit(f"{tag}:"), "tile_id")), "tile_id", "place")
    draw = tiles.sparkSession.range(size).withColumnRenamed("id", "draw")
    draw = draw.withColumn("e", F.floor(C.uniform(f"event{tag}", F.col("draw")) * n_events).cast("int"))
    draw = draw.join(events, "e")
    draw = draw.withColumn("place", F.floor(C.uniform(f"tile{tag}", F.col("draw")) * F.col("n")).cast("long") + 1)
    return draw.join(ranked.select("event_id", "place", "tile_id"), ["event_id", "place"]).select("draw", "event_id", "tile_id")


def greedy_coverage(counts: DataFrame, classes: list[str], count: int, key: str = "tile_id") -> list[str]:
    """Pick tiles one by one so that the rarest damage class is covered best.

    Each round is one distributed maximum of (least class total, sum of log1p totals in millionths,
    own pixels, id); only the winner's counts come to the driver. ``classes``: damage classes.
    """
    total = dict.fromkeys(classes, 0)
    chosen: list[str] = []
    for _ in range(count):
        after = [F.col(c) + F.lit(total[c]) for c in classes]
        least = F.least(*after) if len(after) > 1 else after[0]
        logs = sum((F.log1p(a.cast("double")) for a in after), F.lit(0.0))
        rank = F.struct(least.alias("a"), F.floor(logs * 1_000_000).alias("b"), sum((F.col(c) for c in classes), F.lit(0)).alias("c"), F.col(key).alias("d"))
        rest = counts.where(~F.col(key).isin(*chosen)) if chosen else counts
        best = rest.select(rank.alias("r"), *classes).agg(F.max_by(F.struct("r", *classes), "r").alias("m")).first()["m"]
        if best is None:
            break
        chosen.append(best["r"]["d"])
        total = {c: total[c] + best[c] for c in classes}
    return chosen


def geometry_plan(tiles: DataFrame, index: str, height: str, width: str, crop: int | None = None, seed: int = 42, epoch: int = 0, randomise: bool = True) -> DataFrame:
    """Add hflip, vflip, quarter_turns, top and left: seeded by index and epoch, or a centre crop."""
    tag = F.concat(F.lit(f"{seed}:{epoch}:"), F.col(index).cast("string"))

    def u(name: str) -> Column:
        return C.uniform(name, tag)

    room_y, room_x = (F.greatest(F.col(side) - F.lit(crop or 0), F.lit(0)) for side in (height, width))
    if randomise:
        plan = {"hflip": u("h") < 0.5, "vflip": u("v") < 0.5, "quarter_turns": F.floor(u("q") * 4).cast("int"), "top": F.floor(u("t") * (room_y + 1)).cast("int"), "left": F.floor(u("l") * (room_x + 1)).cast("int")}
    else:
        plan = {"hflip": F.lit(False), "vflip": F.lit(False), "quarter_turns": F.lit(0), "top": F.floor(room_y / 2).cast("int"), "left": F.floor(room_x / 2).cast("int")}
    if crop is None:
        plan |= {"top": F.lit(None).cast("int"), "left": F.lit(None).cast("int")}
    return tiles.withColumns(plan)


def apply_plan(pixels: DataFrame, crop: int | None) -> DataFrame:
    """Move long-form pixels (row, col, height, width, plan columns) to where the plan puts them.

    Crop, then flips, then quarter turns anticlockwise; pixels outside of the crop go. Padding of
    tiles smaller than the crop is a left join of the target lattice and left to the caller.
    """
    rows = pixels
    if crop is not None:
        inside = (F.col("row") >= F.col("top")) & (F.col("row") < F.col("top") + crop) & (F.col("col") >= F.col("left")) & (F.col("col") < F.col("left") + crop)
        rows = rows.where(inside).withColumns({"row": F.col("row") - F.col("top"), "col": F.col("col") - F.col("left"), "height": F.least(F.col("height"), F.lit(crop)), "width": F.least(F.col("width"), F.lit(crop))})
    rows = rows.withColumn("col", F.when(F.col("hflip"), F.col("width") - 1 - F.col("col")).otherwise(F.col("col")))
    rows = rows.withColumn("row", F.when(F.col("vflip"), F.col("height") - 1 - F.col("row")).otherwise(F.col("row")))
    q, r, c, h, w = F.col("quarter_turns"), F.col("row"), F.col("col"), F.col("height"), F.col("width")
    turned_r = F.when(q == 1, w - 1 - c).when(q == 2, h - 1 - r).when(q == 3, c).otherwise(r)
    turned_c = F.when(q == 1, r).when(q == 2, w - 1 - c).when(q == 3, h - 1 - r).otherwise(c)
    odd = q % 2 == 1
    return rows.withColumns({"row": turned_r, "col": turned_c, "height": F.when(odd, w).otherwise(h), "width": F.when(odd, h).otherwise(w)})


def padded(pixels: DataFrame, crop: int, mode: str = "edge", value: str = "value", key: str = "tile_id") -> DataFrame:
    """Long-form pixels of tiles that are smaller than a crop, filled up to it below and to the right.

    edge: the nearest pixel's value; zero: 0. Larger tiles stay as they are.
    """
    if mode not in ("edge", "zero"):
        raise ValueError(f"unknown mode {mode}")
    sizes = pixels.groupBy(key).agg(F.max("height").alias("h"), F.max("width").alias("w"))
    rows = F.explode(F.sequence(F.lit(0), F.greatest(F.col("h"), F.lit(crop)) - 1))
    cols = F.explode(F.sequence(F.lit(0), F.greatest(F.col("w"), F.lit(crop)) - 1))
    target = sizes.withColumn("row", rows).withColumn("col", cols)
    target = target.withColumns({"__r": F.least("row", F.col("h") - 1), "__c": F.least("col", F.col("w") - 1)})
    source = pixels.select(key, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v"))
    full = target.join(source, [key, "__r", "__c"])
    outside = (F.col("row") >= F.col("h")) | (F.col("col") >= F.col("w"))
    v = F.when(outside, F.lit(0).cast(pixels.schema[value].dataType)).otherwise(F.col("__v")) if mode == "zero" else F.col("__v")
    return full.select(key, "row", "col", F.greatest("h", F.lit(crop)).alias("height"), F.greatest("w", F.lit(crop)).alias("width"), v.alias(value))


def top_count(n: int, fraction: float) -> int:
    return max(1, math.ceil(fraction * n))


def partition_mismatch(split: DataFrame, wanted: DataFrame, partition: str = "test", unit: str = "event_id") -> DataFrame:
    """Units of a partition that were not asked for (unexpected), and units asked for that it lacks (missing)."""
    held = split.where(F.col("partition") == partition).select(unit).distinct()
    asked = wanted.select(unit).distinct()
    unexpected = held.join(asked, unit, "left_anti").select(unit, F.lit("unexpected").alias("problem"))
    return unexpected.union(asked.join(held, unit, "left_anti").select(unit, F.lit("missing").alias("problem")))


def pooled(split: DataFrame, partitions: list[str]) -> DataFrame:
    """The rows of several partitions one after the other; a row of two partitions counts twice."""
    parts = [split.where(F.col("partition") == p) for p in partitions]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
