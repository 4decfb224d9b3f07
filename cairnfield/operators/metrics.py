"""Segmentation metrics from confusion counts, pooled and by event, and the Lovasz extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.operators.catalog import IGNORED

METRICS = ("accuracy", "miou", "macro_f1", "f1_localization", "f1_damage")


def confusion(rows: DataFrame, event: str = "event_id", target: str = "target", pred: str = "pred", classes: int = 4) -> DataFrame:
    """Counts of (event, target, pred) with zeros for pairs that don't occur, and pooled ones under a null event."""
    valid = rows.where((F.col(target) != IGNORED) & F.col(target).isNotNull()).select(F.col(event).alias("event_id"), F.col(target).cast("int").alias("target"), F.col(pred).cast("int").alias("pred"))
    cells = valid.groupBy("event_id", "target", "pred").agg(F.count("*").alias("n"))
    counted = cells.unionByName(cells.groupBy("target", "pred").agg(F.sum("n").alias("n")).withColumn("event_id", F.lit(None).cast(cells.schema["event_id"].dataType)))
    pairs = F.explode(F.sequence(F.lit(0), F.lit(classes * classes - 1)))
    place = F.col("target") * classes + F.col("pred")
    # the events are few: their dense matrices are built from one map for each
    maps = counted.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col("n").alias("v")))).alias("m"))
    dense = maps.select("event_id", "m", pairs.alias("k"))
    return dense.select("event_id", F.floor(F.col("k") / classes).cast("int").alias("target"), (F.col("k") % classes).cast("int").alias("pred"), F.coalesce(F.try_element_at("m", "k"), F.lit(0)).cast("long").alias("n"))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("double")


def from_confusion(counts: DataFrame, by: list[str] = ("event_id",), classes: int = 4) -> DataFrame:
    """accuracy, miou, macro_f1, f1_localization, f1_damage, class_iou and class_f1 for each group.

    Class means cover classes with truth; f1_localization counts pixels of the right building class.
    """
    t, p = F.col("target"), F.col("pred")
    sums = [_sum(t == p).alias("tp"), _sum(F.lit(True)).alias("all"), _sum((t == p) & (t > 0)).alias("loc"), _sum(t > 0).alias("truth"), _sum(p > 0).alias("found")]
    for k in range(classes):
        sums += [_sum((t == k) & (p == k)).alias(f"tp{k}"), _sum(t == k).alias(f"s{k}"), _sum(p == k).alias(f"p{k}")]
    one = F.lit(1.0)
    rows = counts.groupBy(*by).agg(*sums)
    iou = [F.col(f"tp{k}") / F.greatest(F.col(f"s{k}") + F.col(f"p{k}") - F.col(f"tp{k}"), one) for k in range(classes)]
    f1 = [2 * F.col(f"tp{k}") / F.greatest(F.col(f"s{k}") + F.col(f"p{k}"), one) for k in range(classes)]

    def mean(values: list[Column], ks) -> Column:
        total = sum((F.when(F.col(f"s{k}") > 0, values[k]).otherwise(0.0) for k in ks), F.lit(0.0))
        n = sum((F.when(F.col(f"s{k}") > 0, 1).otherwise(0) for k in ks), F.lit(0))
        return F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(0.0)

    return rows.select(
        *by,
        F.col("all").cast("long").alias("n_pixels"),
        (F.col("tp") / F.greatest(F.col("all"), one)).alias("accuracy"),
        mean(iou, range(classes)).alias("miou"),
        mean(f1, range(classes)).alias("macro_f1"),
        (2 * F.col("loc") / F.greatest(F.col("truth") + F.col("found"), one)).alias("f1_localization"),
        mean(f1, range(1, classes)).alias("f1_damage"),
        F.array(*iou).alias("class_iou"),
        F.array(*f1).alias("class_f1"),
    )


def binary_building_f1(counts: DataFrame, by: list[str] = ("event_id",)) -> DataFrame:
    """F1 of building against background, whatever the damage class (an addition)."""
    t, p = F.col("target") > 0, F.col("pred") > 0
    rows = counts.groupBy(*by).agg(_sum(t & p).alias("tp"), _sum(t).alias("truth"), _sum(p).alias("found"))
    return rows.select(*by, (2 * F.col("tp") / F.greatest(F.col("truth") + F.col("found"), F.lit(1.0))).alias("f1_building"))


def event_summary(per_event: DataFrame, metrics: list[str]) -> DataFrame:
    """Of each metric over the events: mean, worst (the greatest for ece) and population deviation."""
    long = per_event.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "v"))
    worst = F.when(F.first("metric") == "ece", F.max("v")).otherwise(F.min("v"))
    return long.groupBy("metric").agg(F.avg("v").alias("event_macro"), worst.alias("worst_event"), F.stddev_pop("v").alias("std"))


def bootstrap_events(counts: DataFrame, samples: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile intervals of pooled metrics with events drawn with replacement.

    With one event there is no interval: ``available`` is false and the bounds are null.
    Events are few, and so is (samples * events); their matrices meet the draws in an equi-join.
    """
    from cairnfield.functions.columns import uniform

    events = counts.where("event_id IS NOT NULL").select("event_id").distinct()
    ranked = events.withColumn("e", F.row_number().over(Window.orderBy("event_id")) - 1)  # a dimension table
    n = ranked.count()
    slots = counts.sparkSession.range(samples * max(n, 1)).select((F.col("id") / max(n, 1)).cast("long").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    drawn = slots.withColumn("e", F.floor(uniform(f"bootstrap{seed}", F.col("draw"), F.col("slot")) * n).cast("int"))
    picked = drawn.join(ranked, "e").groupBy("draw", "event_id").agg(F.count("*").alias("times"))
    cells = picked.join(counts, "event_id").groupBy("draw", "target", "pred").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    scores = from_confusion(cells, ["draw"])
    names = ("macro_f1", "miou", "f1_localization", "f1_damage")
    long = scores.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(m) for m in names]))).alias("metric", "v"))
    low, high = (1 - level) / 2, (1 + level) / 2
    bounds = long.groupBy("metric").agg(F.percentile("v", F.lit(low)).alias("lower"), F.percentile("v", F.lit(high)).alias("upper"))
    fine = F.lit(n >= 2)
    return bounds.select("metric", F.lit(n).cast("int").alias("n_units"), fine.alias("available"), *[F.when(fine, F.col(c)).alias(c) for c in ("lower", "upper")])


def lovasz(pixels: DataFrame, group: str, target: str = "target", p: str = "p", classes: int = 4) -> DataFrame:
    """Lovasz-softmax loss of each group: the mean over its present classes.

    Equal errors are counted before they are sorted, foreground first, and a class is sorted in
    slices of its errors (1,000 of them), shifted by the sums of the slices above, so that no class
    of a group has to be sorted in one task.
    """
    long = pixels.where(F.col(target) != IGNORED).select(group, F.col(target).alias("t"), F.posexplode(p).alias("cls", "prob")).where(F.col("cls") < classes)
    fg = (F.col("t") == F.col("cls")).cast("double")
    key = [group, "cls"]
    rows = long.select(*key, fg.alias("fg"), F.abs(fg - F.col("prob")).alias("err")).groupBy(*key, "err", "fg").agg(F.count("*").alias("n"))
    rows = rows.withColumns({"pos": F.col("fg") * F.col("n"), "neg": (1 - F.col("fg")) * F.col("n"), "slice": F.floor(F.greatest(F.least(1 - F.col("err"), F.lit(1.0)), F.lit(0.0)) * 1000)})
    sums = rows.groupBy(*key, "slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    above = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("p").over(Window.partitionBy(*key))
    shifts = sums.select(*key, "slice", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("p", "q")], total.alias("total"))
    running = Window.partitionBy(*key, "slice").orderBy(F.desc("err"), F.desc("fg")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(running) - F.col(c) for c in ("pos", "neg")} | {"own": F.col("pos"), "other": F.col("neg")}).join(shifts, [*key, "slice"])
    seen, others = F.col("pos") + F.col("p_above"), F.col("neg") + F.col("q_above")

    def jaccard(more_seen: Column, more_others: Column) -> Column:
        return 1 - (F.col("total") - more_seen) / F.greatest(F.col("total") + more_others, F.lit(1.0))

    step = jaccard(seen + F.col("own"), others + F.col("other")) - jaccard(seen, others)
    by_class = rows.where("total > 0").groupBy(*key).agg(F.sum(F.col("err") * step).alias("loss"))
    return by_class.groupBy(group).agg(F.avg("loss").alias("lovasz"))


def cross_entropy(pixels: DataFrame, group: list[str], weights: dict[int, float] | None = None, gamma: float = 0.0, target: str = "target", logits: str = "logits") -> DataFrame:
    """Weighted cross entropy of each group, or its focal form with ``gamma``.

    The sum of weighted losses is divided by the sum of the weights of the targets, as is usual for
    a weighted mean; the focal factor is no part of the denominator.
    """
    from cairnfield.functions.columns import log_softmax

    rows = pixels.where((F.col(target) != IGNORED) & F.col(target).isNotNull())
    rows = rows.withColumn("__lp", F.get(log_softmax(F.col(logits)), F.col(target).cast("int")))
    w = F.lit(1.0)
    if weights:
        w = F.create_map(*[F.lit(v) for k, x in weights.items() for v in (int(k), float(x))])[F.col(target).cast("int")]
    loss = -F.col("__lp") * (F.pow(1 - F.exp("__lp"), F.lit(gamma)) if gamma else F.lit(1.0))
    return rows.groupBy(*group).agg((F.sum(w * loss) / F.sum(w)).alias("cross_entropy"))


def head_targets(pixels: DataFrame, target: str = "target") -> DataFrame:
    """Targets of two heads: building or not, and the damage class of building pixels; IGNORED elsewhere."""
    t = F.col(target)
    fine = t != IGNORED
    return pixels.withColumns(
        {
            "location_target": F.when(fine, (t > 0).cast("int")).otherwise(IGNORED),
            "damage_target": F.when(fine & (t > 0), t - 1).otherwise(IGNORED).cast("int"),
        }
    )


def paired_bootstrap(a: DataFrame, b: DataFrame, samples: int, seed: int = 42, metric: str = "f1_damage", level: float = 0.95) -> DataFrame:
    """Interval of a metric's difference between two models (a - b), over the same draws of events (an addition).

    ``a`` and ``b`` are confusion counts over the same events.
    """
    from cairnfield.functions.columns import uniform

    both = a.where("event_id IS NOT NULL").withColumn("model", F.lit(0)).unionByName(b.where("event_id IS NOT NULL").withColumn("model", F.lit(1)))
    events = both.select("event_id").distinct()
    ranked = events.withColumn("e", F.row_number().over(Window.orderBy("event_id")) - 1)  # a dimension table
    n = ranked.count()
    slots = a.sparkSession.range(samples * max(n, 1)).select((F.col("id") / max(n, 1)).cast("long").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    drawn = slots.withColumn("e", F.floor(uniform(f"paired{seed}", F.col("draw"), F.col("slot")) * n).cast("int"))
    picked = drawn.join(ranked, "e").groupBy("draw", "event_id").agg(F.count("*").alias("times"))
    cells = picked.join(both, "event_id").groupBy("draw", "model", "target", "pred").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    scores = from_confusion(cells, ["draw", "model"])
    gaps = scores.groupBy("draw").agg(F.sum(F.when(F.col("model") == 0, F.col(metric)).otherwise(-F.col(metric))).alias("gap"))
    low, high = (1 - level) / 2, (1 + level) / 2
    return gaps.agg(F.avg("gap").alias("mean"), F.percentile("gap", F.lit(low)).alias("lower"), F.percentile("gap", F.lit(high)).alias("upper"))


def segmentation_objective(pixels: DataFrame, group: str, weights: dict[int, float] | None = None, gamma: float = 0.0, lovasz_weight: float = 1.0, classes: int = 4, target: str = "target", logits: str = "logits") -> DataFrame:
    """(group, loss): weighted cross entropy, or its focal form, plus the weighted Lovasz term over probabilities.

    A group whose pixels are all ignored has a loss of zero.
    """
    from cairnfield.functions.columns import softmax

    entropy = cross_entropy(pixels, [group], weights, gamma, target, logits)
    known = pixels.where(F.col(target).isNotNull()).select(group, F.col(target).alias("target"), softmax(F.col(logits)).alias("p"))
    surface = lovasz(known, group, classes=classes)
    rows = pixels.select(group).distinct().join(entropy, group, "left").join(surface, group, "left")
    return rows.select(group, (F.coalesce("cross_entropy", F.lit(0.0)) + lovasz_weight * F.coalesce("lovasz", F.lit(0.0))).alias("loss"))


def dual_head_objective(pixels: DataFrame, group: str, damage_weights: dict[int, float] | None = None, lovasz_weight: float = 1.0, of_location: float = 1.0, of_damage: float = 1.0, target: str = "target", location: str = "location", damage: str = "damage") -> DataFrame:
    """(group, localization, damage, loss): both heads' objectives and their weighted sum.

    ``location`` has two logits and ``damage`` three; a head without a labelled pixel adds nothing.
    """
    rows = head_targets(pixels, target)
    a = segmentation_objective(rows, group, None, 0.0, lovasz_weight, 2, "location_target", location).withColumnRenamed("loss", "localization")
    b = segmentation_objective(rows, group, damage_weights, 0.0, lovasz_weight, 3, "damage_target", damage).withColumnRenamed("loss", "damage")
    return a.join(b, group).withColumn("loss", of_location * F.col("localization") + of_damage * F.col("damage"))
