"""Calibration of building probabilities: reliability, proper scores, temperature, intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.functions.arrays import uniform_rows, uniforms
from cairnfield.operators.iterate import kept
from cairnfield.sources.files import ship

BINS = 15
METRICS = ("ece", "nll", "brier", "macro_f1", "balanced_accuracy")


def scored(rows: DataFrame, temperature: float = 1.0, logits: str = "logits") -> DataFrame:
    """Add p, pred and confidence from logits."""
    rows = rows.withColumn("p", C.softmax(F.col(logits), temperature))
    return rows.withColumns({"pred": C.argmax(F.col("p")), "confidence": F.array_max("p")})


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Right-open bins between i / bins; the last is closed. Compared with the edges themselves."""
    at = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    # the product may round across an edge
    return F.when(confidence < at / F.lit(float(bins)), at - 1).when((at < bins - 1) & (confidence >= (at + 1) / F.lit(float(bins))), at + 1).otherwise(at)


def reliability(rows: DataFrame, bins: int = BINS, target: str = "target", by: list[str] = ()) -> DataFrame:
    """One row for each bin, also the empty ones: count, accuracy and mean confidence."""
    hit = (F.col("pred") == F.col(target)).cast("double")
    found = rows.groupBy(*by, bin_of(F.col("confidence"), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg(hit).alias("accuracy"), F.avg("confidence").alias("confidence"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    scaffold = found.select(*by).distinct().select(*by, every) if by else rows.sparkSession.range(1).select(every)
    full = scaffold.join(found, [*by, "bin"], "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("accuracy", "confidence")]
    edges = [(F.col("bin") / float(bins)).alias("bin_lower"), ((F.col("bin") + 1) / float(bins)).alias("bin_upper")]
    return full.select(*by, "bin", *edges, F.coalesce("count", F.lit(0)).cast("long").alias("count"), *zero)


def ece(bins: DataFrame, by: list[str] = ()) -> DataFrame:
    gap = F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("confidence")))
    return bins.groupBy(*by).agg((gap / F.greatest(F.sum("count"), F.lit(1))).alias("ece"), F.sum("count").alias("n"))


def class_scores(rows: DataFrame, target: str = "target", classes: int = 3, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """nll, brier, macro_f1 and balanced_accuracy over exactly ``classes`` classes (an absent one counts 0)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    t, p = F.col(target), F.col("pred")
    sums = [F.sum(w).alias("n"), F.sum(w * C.nll(F.col("p"), t)).alias("nll"), F.sum(w * C.brier(F.col("p"), t)).alias("brier")]
    for k in range(classes):
        sums += [F.sum(F.when((t == k) & (p == k), w).otherwise(0.0)).alias(f"tp{k}"), F.sum(F.when(t == k, w).otherwise(0.0)).alias(f"s{k}"), F.sum(F.when(p == k, w).otherwise(0.0)).alias(f"f{k}")]
    sums_ = rows.groupBy(*by).agg(*sums)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.greatest(b, F.lit(1e-300))).otherwise(0.0)

    f1 = sum((ratio(2 * F.col(f"tp{k}"), F.col(f"s{k}") + F.col(f"f{k}")) for k in range(classes)), F.lit(0.0)) / classes
    recall = sum((ratio(F.col(f"tp{k}"), F.col(f"s{k}")) for k in range(classes)), F.lit(0.0)) / classes
    return sums_.select(*by, F.col("n").cast("long").alias("n_buildings"), (F.col("nll") / F.col("n")).alias("nll"), (F.col("brier") / F.col("n")).alias("brier"), f1.alias("macro_f1"), recall.alias("balanced_accuracy"))


def temperature_grid(rows: DataFrame, temperatures: list[float], target: str = "target", logits: str = "logits") -> DataFrame:
    """Mean nll at each temperature, in one pass over the rows."""
    nlls = [F.avg(C.nll(C.softmax(F.col(logits), t), F.col(target))).alias(f"t{i}") for i, t in enumerate(temperatures)]
    wide = rows.agg(*nlls)
    pairs = F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)])
    return wide.select(F.explode(pairs).alias("r")).select("r.*")


def fit_temperature(rows: DataFrame, target: str = "target", logits: str = "logits", rounds: int = 4, points: int = 25) -> float:
    """The temperature in [0.05, 20] of least mean nll: each pass refines a logarithmic grid around the best point."""
    low, high, best = math.log(0.05), math.log(20.0), 1.0
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = [math.exp(low + i * step) for i in range(points)]
        row = temperature_grid(rows, grid, target, logits).where("nll IS NOT NULL").agg(F.min_by("temperature", "nll").alias("t")).first()
        if row["t"] is None:
            raise ValueError("Cannot calibrate an empty validation set")
        best = row["t"]
        low, high = max(math.log(0.05), math.log(best) - step), min(math.log(20.0), math.log(best) + step)
    return best


#: Rows of a slice of a bootstrap, groups of draws that share a slice's work, and picks that one step deals to slices.
IN_SLICE, DRAW_GROUPS, PICKS = 10_000, 8, 1_000_000
#: Picks of a slice, or its rows by draws, that are in work at once.
SUMMED = 1 << 20


def bootstrap(rows: DataFrame, samples: int, key: str, seed: int = 42, target: str = "target", level: float = 0.95, classes: int = 3, in_slice: int = IN_SLICE) -> DataFrame:
    """Percentile intervals of all METRICS with buildings drawn with replacement.

    Draws go down a tree: rows lie in slices by a hash of their key; each draw's picks are first counted by slice, in
    proportion to the slices' rows, and then fall on places within a slice, where its rows are. So a row meets its
    counts in place, and what is shuffled are the slices (once for each of DRAW_GROUPS) and sums by draw and slice.
    """
    ship(rows.sparkSession)
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "metric string, lower double, upper double")
    slices = -(-n // in_slice)
    text = F.col(key).cast("string")
    t = F.col(target)
    numbers = {"nll": C.nll(F.col("p"), t), "brier": C.brier(F.col("p"), t), "t": t, "pred": F.col("pred"), "bin": bin_of(F.col("confidence")), "confidence": F.col("confidence")}
    names = list(numbers)
    part = F.floor(C.uniform(f"slice{seed}", F.col(key)) * slices).cast("int")
    placed = rows.select(part.alias("slice"), F.md5(text).alias("h"), text.alias("k"), *[v.cast("double").alias(c) for c, v in numbers.items()])

    def pack(batches):
        now, held = None, []

        def done():
            body = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([body.tobytes()], pa.binary())], names=["slice", "n", "body"])

        for batch in batches:
            of = batch.column("slice").to_numpy()
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if of[a] != now and held:
                    yield done()
                    held = []
                now = int(of[a])
                held.append(values[a:b])
        if held:
            yield done()

    packs = kept(placed.repartition(slices, "slice").sortWithinPartitions("slice", "h", "k").mapInArrow(pack, "slice int, n long, body binary"))
    sizes = np.zeros(slices, dtype=np.int64)
    for r in packs.select("slice", "n").collect():  # one for every ``in_slice`` rows
        sizes[r.slice] = r.n
    counts = _picks(spark, samples, n, sizes, seed)
    group = (F.col("draw") % DRAW_GROUPS).cast("int")
    by_slice = counts.groupBy("slice", group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("draw", "c"))).alias("draws"))  # samples / DRAW_GROUPS each
    width = 3 + 3 * classes + 3 * BINS

    def add(batches):
        for batch in batches:
            for r in batch.to_pylist():
                body = np.frombuffer(r["body"]).reshape(r["n"], -1)
                truth, pred, at = (body[:, i].astype(np.int64) for i in (2, 3, 4))
                hit = (pred == truth)[:, None]
                of = lambda x, k: (x[:, None] == np.arange(k)).astype(np.float64)
                one = np.ones((r["n"], 1))
                each = np.hstack([one, body[:, :2], hit * of(truth, classes), of(truth, classes), of(pred, classes), hit * of(at, BINS), body[:, [5]] * of(at, BINS), of(at, BINS)])
                draws, c = [d["draw"] for d in r["draws"]], np.array([d["c"] for d in r["draws"]])
                sums = []
                step = max(1, SUMMED // max(r["n"], int(c.max())))
                for first in range(0, len(draws), step):
                    some, own = c[first : first + step], draws[first : first + step]
                    u = uniform_rows(f"place{seed}", [f"{d}:{r['slice']}" for d in own], int(some.max()))
                    drawn = np.arange(u.shape[1]) < some[:, None]
                    place = np.floor(u * r["n"]).astype(np.int64) + np.arange(len(own))[:, None] * r["n"]
                    w = np.bincount(place[drawn], minlength=len(own) * r["n"]).reshape(len(own), -1)
                    sums.append(w.astype(np.float64) @ each)
                flat = np.concatenate(sums).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(draws) + 1) * width, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), lists], names=["draw", "x"])

    parts = packs.join(by_slice, "slice").repartition(slices * DRAW_GROUPS, "slice", "g").mapInArrow(add, "draw long, x array<double>")
    total = parts.groupBy("draw").agg(*[F.sum(F.get("x", i)).alias(f"x{i}") for i in range(width)])
    x = [F.col(f"x{i}") for i in range(width)]
    tp, truth, found = (x[3 + i * classes : 3 + (i + 1) * classes] for i in range(3))
    hits, conf, _ = (x[3 + 3 * classes + i * BINS : 3 + 3 * classes + (i + 1) * BINS] for i in range(3))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.greatest(b, F.lit(1e-300))).otherwise(0.0)

    scores = {
        "ece": sum((F.abs(a - b) for a, b in zip(hits, conf, strict=True)), F.lit(0.0)) / x[0],
        "nll": x[1] / x[0],
        "brier": x[2] / x[0],
        "macro_f1": sum((ratio(2 * a, b + c) for a, b, c in zip(tp, truth, found, strict=True)), F.lit(0.0)) / classes,
        "balanced_accuracy": sum((ratio(a, b) for a, b in zip(tp, truth, strict=True)), F.lit(0.0)) / classes,
    }
    long = total.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*[scores[m] for m in METRICS]))).alias("metric", "v"))
    low, high = (1 - level) / 2, (1 + level) / 2
    return long.groupBy("metric").agg(F.percentile("v", F.lit(low)).alias("lower"), F.percentile("v", F.lit(high)).alias("upper"))


def _picks(spark, samples: int, n: int, sizes: np.ndarray, seed: int) -> DataFrame:
    """(draw, slice, c): how many of each draw's n picks fall into each slice."""
    if len(sizes) == 1:
        return spark.range(samples).select(F.col("id").alias("draw"), F.lit(0).alias("slice"), F.lit(n).cast("long").alias("c"))
    ends = np.cumsum(sizes)
    steps = -(-n // PICKS)

    def deal(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                draw, step = divmod(i, steps)
                some = min(PICKS, n - step * PICKS)
                at = np.floor(uniforms(f"pick{seed}", str(draw), some, step * PICKS) * n).astype(np.int64)
                c = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(ends))
                hit = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), draw), pa.int64()), pa.array(hit.astype(np.int32)), pa.array(c[hit], pa.int64())], names=["draw", "slice", "c"])

    return spark.range(samples * steps).mapInArrow(deal, "draw long, slice int, c long").groupBy("draw", "slice").agg(F.sum("c").alias("c"))


# components


def component_means(pixels: DataFrame, key: list[str], values: str, n: int, renormalise: bool = False, order: list[str] | None = None) -> DataFrame:
    """pixel_count and the mean array of each component; means of probabilities are renormalised on demand.

    Calibration averages logits, inference averages probabilities: both are this operator.
    ``order``: columns in whose order a component's values are added. Without it the last bits of a mean
    depend on how the rows were dealt, and so does the class of a component whose means tie.
    """
    out = C.renormalised(F.col("mean")) if renormalise else F.col("mean")
    if order is None:
        means = F.array(*[F.avg(F.get(values, i)) for i in range(n)])
        return pixels.groupBy(*key).agg(F.count("*").alias("pixel_count"), means.alias("mean")).withColumn("mean", out)
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = F.array(*[F.sum(F.get(values, i)).over(so_far) for i in range(n)])
    known = F.array(*[F.count(F.get(values, i)).over(so_far) for i in range(n)])
    running = pixels.select(*key, F.struct(F.count("*").over(so_far).alias("pixel_count"), sums.alias("sums"), known.alias("known")).alias("all"))
    last = running.groupBy(*key).agg(F.max("all").alias("all"))  # the count comes first in it
    means = F.array(*[F.try_divide(F.col("all.sums")[i], F.col("all.known")[i]) for i in range(n)])
    return last.select(*key, F.col("all.pixel_count").alias("pixel_count"), means.alias("mean")).withColumn("mean", out)


def majority_class(pixels: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """The most frequent class of each component; the lowest id wins a tie."""
    counts = pixels.groupBy(*key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("low"))).alias("target_class_id"))


def building_rows(components: DataFrame, temperature: float, tile: str = "tile_id") -> DataFrame:
    """Evaluation rows: id, probabilities, class, severity and entropy of each component's mean logits."""
    rows = components.withColumn("p", C.softmax(F.col("mean"), temperature))
    return rows.withColumns(
        {
            "building_id": F.concat_ws(":", F.col("event_id").cast("string"), F.col(tile).cast("string"), F.col("component").cast("string")),
            "predicted_class": F.element_at(F.array(F.lit("intact"), F.lit("damaged"), F.lit("destroyed")), C.argmax(F.col("p")) + 1),
            "expected_severity": C.expected_severity(F.col("p")),
            "predictive_entropy": C.normalised_entropy(F.col("p"), 3),
            "temperature": F.lit(temperature),
        }
    )


def inference_building_id(tile: Column, component: Column) -> Column:
    return F.concat(tile, F.lit("_building_"), F.lpad(component.cast("string"), 6, "0"))


def numbered_components(components: DataFrame, tile: str, first_pixel: str) -> DataFrame:
    """Number components 1, 2, .. within a tile by their first pixel in raster order."""
    return components.withColumn("component_number", F.row_number().over(Window.partitionBy(tile).orderBy(first_pixel)))
