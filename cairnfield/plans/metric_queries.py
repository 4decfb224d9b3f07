"""Queries on probabilities, segmentation metrics and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.operators import calibration, metrics
from cairnfield.plans.analogues import component_pixels, load, pixels, scored_buildings, softmax_sql, sql_uniform, with_sql

TEMPERATURE = 0.1  # the embeddings' logits are small
GRID = [0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]
DRAWS = 1000


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.softmax(F.col("logits"), TEMPERATURE)
    rows = pixels(spark, sf_dir).select("vec_id", p.alias("p"))
    return rows.select("vec_id", *[F.round(F.col("p")[k], 6).alias(f"p{k}") for k in range(4)], C.argmax(F.col("p")).alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"))


def entropy_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.scored(scored_buildings(spark, sf_dir), TEMPERATURE)
    names = F.element_at(F.array(F.lit("intact"), F.lit("damaged"), F.lit("destroyed")), F.col("pred") + 1)
    return rows.select("vec_id", F.round(C.normalised_entropy(F.col("p"), 3), 6).alias("entropy"), F.round(C.expected_severity(F.col("p")), 6).alias("severity"), names.alias("predicted_class"))


def dual_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    where = F.array(*[F.get("embedding", i).cast("double") for i in range(2)])
    what = F.array(*[F.get("embedding", i).cast("double") for i in range(2, 5)])
    rows = e.select("vec_id", C.dual_heads_to_four_class(where, what).alias("l"), C.dual_head_probabilities(where, what, 0.5).alias("p"))
    return rows.select("vec_id", *[F.round(F.col(c)[k], 6).alias(f"{c}{k}") for c in "lp" for k in range(4)])


def probability_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of raw values that are valid probabilities, renormalised."""
    p = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).where(C.valid_probabilities(F.col("p")))
    q = C.renormalised(F.col("p"))
    return rows.select("vec_id", *[F.round(q[k], 6).alias(f"p{k}") for k in range(3)])


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(pixels(spark, sf_dir).withColumn("pred", C.argmax(F.col("logits"))))


def _named(event: str = "event_id"):
    """The event as text; the pooled rows, whose event is null, by name."""
    return F.coalesce(F.col(event).cast("string"), F.lit("pooled")).alias(event)


def confusion_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir).select(_named(), "target", "pred", "n")


def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.from_confusion(_confusion(spark, sf_dir))
    return m.select(_named(), "n_pixels", *_r(*metrics.METRICS), *[F.round(F.col(c)[k], 6).alias(f"{c}_{k}") for c in ("class_iou", "class_f1") for k in range(4)])


def building_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_building_f1(_confusion(spark, sf_dir)).select(_named(), *_r("f1_building"))


def _event_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.scored(pixels(spark, sf_dir), TEMPERATURE)
    return calibration.ece(calibration.reliability(rows, by=["event_id"]), ["event_id"]).select("event_id", "ece")


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_event = metrics.from_confusion(_confusion(spark, sf_dir)).where("event_id IS NOT NULL").join(_event_ece(spark, sf_dir), "event_id")
    return metrics.event_summary(per_event, ["miou", "macro_f1", "f1_localization", "f1_damage", "ece"]).select("metric", *_r("event_macro", "worst_event", "std"))


def disaster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-event accuracy with the event's disaster type, unknown where there is none."""
    m = metrics.from_confusion(_confusion(spark, sf_dir)).where("event_id IS NOT NULL")
    types = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("event_id"), F.lower("r_name").alias("t"))
    return m.join(types, "event_id", "left").select("event_id", F.coalesce("t", F.lit("unknown")).alias("disaster_type"), *_r("accuracy"))


def ece_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.scored(scored_buildings(spark, sf_dir), TEMPERATURE)
    return calibration.reliability(rows).select("bin", "count", *_r("bin_lower", "bin_upper", "accuracy", "confidence"))


def pixel_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_ece(spark, sf_dir).select("event_id", *_r("ece"))


def building_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nll, brier, macro F1 and balanced accuracy."""
    rows = calibration.scored(scored_buildings(spark, sf_dir), TEMPERATURE)
    return calibration.class_scores(rows).select("n_buildings", *_r("nll", "brier", "macro_f1", "balanced_accuracy"))


def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.temperature_grid(scored_buildings(spark, sf_dir), GRID).select("temperature", *_r("nll"))


def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted temperature and its mean nll: fitted on even ids, scored on odd ones."""
    rows = scored_buildings(spark, sf_dir)
    t = calibration.fit_temperature(rows.where("vec_id % 2 = 0"))
    return calibration.class_scores(calibration.scored(rows.where("vec_id % 2 = 1"), t)).select(F.round(F.lit(t), 6).alias("temperature"), *_r("nll"))


def bootstrap_ci_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap_events(_confusion(spark, sf_dir), DRAWS).select("metric", "n_units", "available", *_r("lower", "upper"))


#: Rows of a slice: few, so that small tables have several.
IN_SLICE = 150


def bootstrap_ci_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.scored(scored_buildings(spark, sf_dir), TEMPERATURE)
    return calibration.bootstrap(rows, DRAWS, "vec_id", in_slice=IN_SLICE).select("metric", *_r("lower", "upper"))


def component_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = calibration.component_means(component_pixels(spark, sf_dir), ["component"], "logits", 3)
    return m.select("component", "pixel_count", *[F.round(F.col("mean")[k], 6).alias(f"logit_{k}") for k in range(3)])


def component_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = component_pixels(spark, sf_dir).withColumn("p", C.softmax(F.col("logits")))
    m = calibration.component_means(rows, ["component"], "p", 3, renormalise=True)
    return m.select(calibration.inference_building_id(F.lit("tile"), F.col("component")).alias("building_id"), "pixel_count", *[F.round(F.col("mean")[k], 6).alias(f"p{k}") for k in range(3)])


def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.majority_class(component_pixels(spark, sf_dir), ["component"])


def building_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of buildings, from mean logits and the majority class."""
    px = component_pixels(spark, sf_dir, place=True)
    m = calibration.component_means(px, ["component"], "logits", 3, order=["file", "row"]).join(calibration.majority_class(px, ["component"]), "component")
    rows = calibration.building_rows(m.withColumns({"event_id": F.col("component") % 8, "tile_id": F.col("component") % 100}), 1.0)
    return rows.select("building_id", "pixel_count", "target_class_id", "predicted_class", *_r("expected_severity", "predictive_entropy"))


def buildings_per_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = component_pixels(spark, sf_dir).where("label > 0")
    return px.groupBy((F.col("component") % 100).alias("tile_id")).agg(F.count_distinct("component").alias("n_buildings"))


def lovasz_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).select("event_id", "target", F.transform(C.softmax(F.col("logits"), TEMPERATURE), lambda x: F.round(x, 9)).alias("p"))
    return metrics.lovasz(rows, "event_id").select("event_id", *_r("lovasz"))


WEIGHTS, GAMMA = {0: 0.5, 1: 1.0, 2: 2.0, 3: 4.0}, 2.0


def segmentation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cross entropy and its focal form by event."""
    px = pixels(spark, sf_dir)
    plain = metrics.cross_entropy(px, ["event_id"], WEIGHTS)
    focal = metrics.cross_entropy(px, ["event_id"], WEIGHTS, GAMMA).withColumnRenamed("cross_entropy", "focal")
    return plain.join(focal, "event_id").select("event_id", *_r("cross_entropy", "focal"))


def dual_head_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy of the two heads over all pixels that count for each."""
    rows = metrics.head_targets(pixels(spark, sf_dir)).withColumns({"location": F.slice("logits", 1, 2), "damage": F.slice("logits", 2, 3), "k": F.lit(0)})
    a = metrics.cross_entropy(rows, ["k"], target="location_target", logits="location").withColumnRenamed("cross_entropy", "localization")
    b = metrics.cross_entropy(rows, ["k"], {0: 1.0, 1: 2.0, 2: 3.0}, target="damage_target", logits="damage").withColumnRenamed("cross_entropy", "damage")
    return a.join(b, "k").select(*_r("localization", "damage"), F.round(F.col("localization") + F.col("damage"), 6).alias("total"))


def segmentation_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number by event: weighted cross entropy plus half of the Lovasz term."""
    return metrics.segmentation_objective(pixels(spark, sf_dir), "event_id", WEIGHTS, lovasz_weight=0.5).select("event_id", *_r("loss"))


def dual_head_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both heads by event, each with its Lovasz term, and their weighted sum."""
    rows = pixels(spark, sf_dir).withColumns({"location": F.slice("logits", 1, 2), "damage": F.slice("logits", 2, 3)})
    found = metrics.dual_head_objective(rows, "event_id", {0: 1.0, 1: 2.0, 2: 3.0}, 0.5, 1.0, 2.0)
    return found.select("event_id", *_r("localization", "damage", "loss"))


def class_frequencies_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth classes of each event with their share (an addition to the global histogram)."""
    counts = pixels(spark, sf_dir).groupBy("event_id", "target").agg(F.count("*").alias("n"))
    total = counts.groupBy("event_id").agg(F.sum("n").alias("total"))
    return counts.join(total, "event_id").select("event_id", "target", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the first four logits against the next four, over the same draws of events."""
    e = load(spark, sf_dir, "embeddings")
    models = []
    for first in (0, 4):
        logits = F.array(*[F.get("embedding", first + i) for i in range(4)])
        rows = e.select((F.col("vec_id") % 8).alias("event_id"), (F.col("label") % 4).alias("target"), C.argmax(logits).alias("pred"))
        models.append(metrics.confusion(rows))
    return metrics.paired_bootstrap(*models, DRAWS, metric="accuracy").select(*_r("mean", "lower", "upper"))


QUERIES = {f.__name__: f for f in (softmax_probs, entropy_severity, dual_heads, probability_validity, confusion_by_event, segmentation_metrics, building_f1, event_summary, disaster_lookup, ece_reliability, pixel_ece, building_scores, temperature_grid, temperature_fit, bootstrap_ci_event, bootstrap_ci_building, component_aggregate, component_probabilities, majority_class, building_rows, buildings_per_mask, lovasz_metric, segmentation_loss, dual_head_loss, segmentation_objective, dual_head_objective, class_frequencies_by_event, paired_bootstrap)}

_P4 = f"p4 AS (SELECT vec_id, event_id, target, {softmax_sql('logits', 4, str(TEMPERATURE))} AS p FROM pixels)"
_P3 = f"p3 AS (SELECT vec_id, event_id, target, {softmax_sql('logits', 3, str(TEMPERATURE))} AS p FROM scored_buildings)"
_S4 = "s4 AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS confidence FROM p4)"
_S3 = "s3 AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS confidence FROM p3)"


def _bin(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} < {i}/15.0::DOUBLE THEN {i - 1}" for i in range(1, 15)) + " ELSE 14 END"


_CM = """cm AS (
  SELECT e.event_id, t.k AS target, q.k AS pred, count(x.vec_id) AS n
  FROM (SELECT DISTINCT event_id FROM pixels UNION ALL SELECT NULL) e CROSS JOIN range(4) t(k) CROSS JOIN range(4) q(k)
  LEFT JOIN (SELECT vec_id, event_id, target, list_position(logits, list_max(logits)) - 1 AS pred FROM pixels) x
    ON (e.event_id IS NULL OR x.event_id = e.event_id) AND x.target = t.k AND x.pred = q.k
  GROUP BY 1, 2, 3)"""


def _metrics_sql(source: str, by: str) -> str:
    tp = [f"sum(n) FILTER (WHERE target = {k} AND pred = {k})" for k in range(4)]
    s = [f"sum(n) FILTER (WHERE target = {k})" for k in range(4)]
    p = [f"sum(n) FILTER (WHERE pred = {k})" for k in range(4)]
    cols = ", ".join(f"coalesce({tp[k]}, 0)::DOUBLE AS tp{k}, coalesce({s[k]}, 0)::DOUBLE AS s{k}, coalesce({p[k]}, 0)::DOUBLE AS p{k}" for k in range(4))
    iou = [f"tp{k} / greatest(s{k} + p{k} - tp{k}, 1)" for k in range(4)]
    f1 = [f"2 * tp{k} / greatest(s{k} + p{k}, 1)" for k in range(4)]

    def mean(v: list[str], ks) -> str:
        total = " + ".join(f"CASE WHEN s{k} > 0 THEN {v[k]} ELSE 0 END" for k in ks)
        n = " + ".join(f"CASE WHEN s{k} > 0 THEN 1 ELSE 0 END" for k in ks)
        return f"coalesce(({total}) / nullif({n}, 0), 0)"

    return f"""SELECT {by}, CAST(every AS BIGINT) AS n_pixels, (tp0 + tp1 + tp2 + tp3) / greatest(every, 1) AS accuracy, {mean(iou, range(4))} AS miou,
  {mean(f1, range(4))} AS macro_f1, 2 * (tp1 + tp2 + tp3) / greatest(s1 + s2 + s3 + p1 + p2 + p3, 1) AS f1_localization, {mean(f1, range(1, 4))} AS f1_damage,
  {', '.join(f'{v} AS class_iou_{k}' for k, v in enumerate(iou))}, {', '.join(f'{v} AS class_f1_{k}' for k, v in enumerate(f1))}
FROM (SELECT {by}, sum(n)::DOUBLE AS every, {cols} FROM {source} GROUP BY {by})"""


_ROUNDED = [*metrics.METRICS, *[f"class_iou_{k}" for k in range(4)], *[f"class_f1_{k}" for k in range(4)]]
_ECE4 = f"""ece4 AS (SELECT event_id, sum(n * abs(a - c)) / sum(n) AS ece FROM (
  SELECT event_id, {_bin('confidence')} AS bin, count(*) AS n, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS a, avg(confidence) AS c FROM s4 GROUP BY 1, 2) GROUP BY 1)"""


def _scores_sql(source: str, by: str, w: str) -> str:
    tp = [f"sum(CASE WHEN target = {k} AND pred = {k} THEN {w} ELSE 0 END)" for k in range(3)]
    s = [f"sum(CASE WHEN target = {k} THEN {w} ELSE 0 END)" for k in range(3)]
    f = [f"sum(CASE WHEN pred = {k} THEN {w} ELSE 0 END)" for k in range(3)]
    f1 = " + ".join(f"coalesce(2.0 * {tp[k]} / nullif({s[k]} + {f[k]}, 0), 0)" for k in range(3))
    rec = " + ".join(f"coalesce(1.0 * {tp[k]} / nullif({s[k]}, 0), 0)" for k in range(3))
    brier = " + ".join(f"(p[{k + 1}] - CASE WHEN target = {k} THEN 1 ELSE 0 END) * (p[{k + 1}] - CASE WHEN target = {k} THEN 1 ELSE 0 END)" for k in range(3))
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}CAST(sum({w}) AS BIGINT) AS n_buildings, sum({w} * -ln(greatest(p[target + 1], 1e-12))) / sum({w}) AS nll, sum({w} * ({brier})) / sum({w}) AS brier,
  ({f1}) / 3 AS macro_f1, ({rec}) / 3 AS balanced_accuracy FROM {source}{group}"""


_BOOT = f"""whole AS (SELECT count(*) AS n, CAST(ceil(count(*) / {IN_SLICE}.0) AS BIGINT) AS slices FROM s3),
places AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place
  FROM (SELECT s3.*, CAST(floor({sql_uniform("'slice42:' || vec_id")} * slices) AS BIGINT) AS slice FROM s3, whole)),
slices AS (SELECT slice, count(*) AS size, sum(count(*)) OVER (ORDER BY slice) AS upto FROM places GROUP BY slice),
picks AS (SELECT d, s, CAST(floor({sql_uniform("'pick42:' || d || ':' || s")} * n) AS BIGINT) AS spot FROM range({DRAWS}) t(d), range((SELECT n FROM whole)) u(s), whole),
dealt AS (SELECT d, slice, size, row_number() OVER (PARTITION BY d, slice ORDER BY s) - 1 AS i FROM picks JOIN slices ON spot >= upto - size AND spot < upto),
draws AS (SELECT d AS draw, slice, CAST(floor({sql_uniform("'place42:' || d || ':' || slice || ':' || i")} * size) AS BIGINT) AS place FROM dealt),
picked AS (SELECT * FROM draws JOIN places USING (slice, place))"""

_WT = "CASE target " + " ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in WEIGHTS.items()) + " END"


def _ce(values: str, n: int, target: str) -> str:
    """Minus the log probability of a target."""
    total = " + ".join(f"exp({values}[{i}] - list_max({values}))" for i in range(1, n + 1))
    return f"(ln({total}) - ({values}[{target} + 1] - list_max({values})))"


def _lovasz_sql(name: str, source: str, p: str, target: str, classes: int) -> str:
    """Common tables that end in ``name`` (event_id, v): the mean over present classes; ``source`` has the pixels that count."""
    n = name
    return f"""{n}_l AS (SELECT event_id, k AS cls, CASE WHEN {target} = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fg, {p}[k + 1] AS prob FROM {source}, range({classes}) t(k)),
{n}_e AS (SELECT *, abs(fg - prob) AS err, sum(fg) OVER (PARTITION BY event_id, cls) AS total FROM {n}_l),
{n}_c AS (SELECT *, sum(fg) OVER w AS seen, sum(1 - fg) OVER w AS others FROM {n}_e WINDOW w AS (PARTITION BY event_id, cls ORDER BY err DESC, fg DESC ROWS UNBOUNDED PRECEDING)),
{n}_j AS (SELECT *, 1 - (total - seen) / greatest(total + others, 1) AS jac FROM {n}_c),
{n}_d AS (SELECT event_id, cls, err, total, jac - coalesce(lag(jac) OVER (PARTITION BY event_id, cls ORDER BY err DESC, fg DESC, jac), 0) AS step FROM {n}_j),
{n} AS (SELECT event_id, avg(loss) AS v FROM (SELECT event_id, cls, sum(err * step) AS loss FROM {n}_d WHERE total > 0 GROUP BY 1, 2) GROUP BY 1)"""


def _fit_sql(rounds: int = 4, points: int = 25) -> str:
    """Common tables up to ``best``: each round's grid lies around the last one's best temperature."""
    low, high = "ln(0.05::DOUBLE)", "ln(20.0::DOUBLE)"
    out = [f"even AS (SELECT * FROM scored_buildings WHERE vec_id % 2 = 0), f0 AS (SELECT {low} AS low, {high} AS high)"]
    for k in range(1, rounds + 1):
        out.append(f"g{k} AS (SELECT exp(low + i * ((high - low) / {points - 1})) AS t, (high - low) / {points - 1} AS step FROM f{k - 1}, range({points}) r(i))")
        out.append(f"e{k} AS (SELECT t, any_value(step) AS step, avg(-ln(greatest(({softmax_sql('logits', 3, 't')})[target + 1], 1e-12))) AS nll FROM g{k}, even GROUP BY t)")
        out.append(f"b{k} AS (SELECT arg_min(t, nll) AS best, any_value(step) AS step FROM e{k}), f{k} AS (SELECT greatest({low}, ln(best) - step) AS low, least({high}, ln(best) + step) AS high FROM b{k})")
    return ",\n".join(out) + f", best AS (SELECT best FROM b{rounds})"


ORACLES = {
    "temperature_fit": f"""{with_sql('scored_buildings')}, {_fit_sql()}
SELECT round(best, 6) AS temperature, round(avg(-ln(greatest(({softmax_sql('logits', 3, 'best')})[target + 1], 1e-12))), 6) AS nll FROM scored_buildings, best WHERE vec_id % 2 = 1 GROUP BY best""",
    "segmentation_objective": f"""{with_sql('pixels')}, l AS (SELECT *, {_WT} AS w, {_ce('logits', 4, 'target')} AS ce, {softmax_sql('logits', 4)} AS p FROM pixels),
{_lovasz_sql('lz', 'l', 'p', 'target', 4)}
SELECT l.event_id, round(sum(w * ce) / sum(w) + 0.5 * any_value(lz.v), 6) AS loss FROM l JOIN lz USING (event_id) GROUP BY 1""",
    "dual_head_objective": f"""{with_sql('pixels')}, h AS (SELECT event_id, target, logits[1:2] AS a, logits[2:4] AS b, CAST(target > 0 AS INTEGER) AS loc, target - 1 AS dmg FROM pixels),
s AS (SELECT *, {softmax_sql('a', 2)} AS pa, {softmax_sql('b', 3)} AS pb, {_ce('a', 2, 'loc')} AS ca FROM h), q AS (SELECT *, {_ce('b', 3, 'dmg')} AS cb FROM s WHERE target > 0),
{_lovasz_sql('la', 's', 'pa', 'loc', 2)},
{_lovasz_sql('lb', 'q', 'pb', 'dmg', 3)},
x AS (SELECT event_id, avg(ca) + 0.5 * any_value(la.v) AS a FROM s JOIN la USING (event_id) GROUP BY 1),
y AS (SELECT event_id, sum(target * cb) / sum(target) + 0.5 * any_value(lb.v) AS b FROM q JOIN lb USING (event_id) GROUP BY 1)
SELECT x.event_id, round(a, 6) AS localization, round(coalesce(b, 0), 6) AS damage, round(a + 2.0 * coalesce(b, 0), 6) AS loss FROM x LEFT JOIN y USING (event_id)""",
    "segmentation_loss": f"""{with_sql('pixels')}, l AS (SELECT event_id, {_WT} AS w, {_ce('logits', 4, 'target')} AS ce FROM pixels)
SELECT event_id, round(sum(w * ce) / sum(w), 6) AS cross_entropy, round(sum(w * ce * (1 - exp(-ce)) * (1 - exp(-ce))) / sum(w), 6) AS focal FROM l GROUP BY 1""",
    "dual_head_loss": f"""{with_sql('pixels')}, h AS (SELECT target, logits[1:2] AS a, logits[2:4] AS b FROM pixels),
l AS (SELECT avg({_ce('a', 2, 'CAST(target > 0 AS INTEGER)')}) AS v FROM h), d AS (SELECT sum(target * {_ce('b', 3, '(target - 1)')}) / sum(target) AS v FROM h WHERE target > 0)
SELECT round(l.v, 6) AS localization, round(d.v, 6) AS damage, round(l.v + d.v, 6) AS total FROM l, d""",
    "class_frequencies_by_event": f"""{with_sql('pixels')} SELECT event_id, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_id), 6) AS share FROM pixels GROUP BY 1, 2""",
    "paired_bootstrap": f"""WITH ev AS (SELECT k AS event_id, row_number() OVER (ORDER BY k) - 1 AS e FROM (SELECT DISTINCT vec_id % 8 AS k FROM embeddings)),
h AS (SELECT vec_id % 8 AS event_id, count(*) AS n, sum(CASE WHEN list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label % 4 THEN 1.0::DOUBLE ELSE 0 END) AS a, sum(CASE WHEN list_position(embedding[5:8], list_max(embedding[5:8])) - 1 = label % 4 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM embeddings GROUP BY 1),
draws AS (SELECT d AS draw, CAST(floor({sql_uniform("'paired42:' || d || ':' || s")} * (SELECT count(*) FROM ev)) AS BIGINT) AS e FROM range({DRAWS}) t(d), range((SELECT count(*) FROM ev)) u(s)),
g AS (SELECT draw, sum(a) / sum(n) - sum(b) / sum(n) AS gap FROM draws JOIN ev USING (e) JOIN h USING (event_id) GROUP BY 1)
SELECT round(avg(gap), 6) AS mean, round(quantile_cont(gap, 0.025), 6) AS lower, round(quantile_cont(gap, 0.975), 6) AS upper FROM g""",
    "softmax_probs": f"""{with_sql('pixels')}, {_P4}, {_S4} SELECT vec_id, {', '.join(f'round(p[{k + 1}], 6) AS p{k}' for k in range(4))}, CAST(pred AS INTEGER) AS pred, round(confidence, 6) AS confidence FROM s4""",
    "entropy_severity": f"""{with_sql('scored_buildings')}, {_P3}, {_S3} SELECT vec_id, round(-({' + '.join(f'p[{k}] * ln(greatest(p[{k}], 1e-12))' for k in (1, 2, 3))}) / ln(3), 6) AS entropy,
  round(p[2] + 2 * p[3], 6) AS severity, ['intact', 'damaged', 'destroyed'][pred + 1] AS predicted_class FROM s3""",
    "dual_heads": "WITH z AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS w, [CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE), CAST(embedding[5] AS DOUBLE)] AS d FROM embeddings), "
    + "s AS (SELECT vec_id, " + softmax_sql("w", 2) + " AS w1, " + softmax_sql("d", 3) + " AS d1, " + softmax_sql("d", 3, "0.5") + " AS d2 FROM z) "
    + "SELECT vec_id, round(ln(w1[1]), 6) AS l0, " + ", ".join(f"round(ln(w1[2]) + ln(d1[{k}]), 6) AS l{k}" for k in (1, 2, 3)) + ", round(w1[1], 6) AS p0, " + ", ".join(f"round(w1[2] * d2[{k}], 6) AS p{k}" for k in (1, 2, 3)) + " FROM s",
    "probability_validity": f"""WITH z AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT vec_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM z WHERE a >= 0 AND b >= 0 AND c >= 0 AND a + b + c > 0""",
    "confusion_by_event": f"{with_sql('pixels')}, {_CM} SELECT coalesce(CAST(event_id AS VARCHAR), 'pooled') AS event_id, CAST(target AS INTEGER) AS target, CAST(pred AS INTEGER) AS pred, n FROM cm",
    "segmentation_metrics": f"{with_sql('pixels')}, {_CM}, m AS ({_metrics_sql('cm', 'event_id')}) SELECT coalesce(CAST(event_id AS VARCHAR), 'pooled') AS event_id, n_pixels, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM m",
    "building_f1": f"""{with_sql('pixels')}, {_CM} SELECT coalesce(CAST(event_id AS VARCHAR), 'pooled') AS event_id, round(2.0 * coalesce(sum(n) FILTER (WHERE target > 0 AND pred > 0), 0) / greatest(sum(n) FILTER (WHERE target > 0) + sum(n) FILTER (WHERE pred > 0), 1), 6) AS f1_building FROM cm GROUP BY cm.event_id""",
    "event_summary": f"""{with_sql('pixels')}, {_CM}, {_P4}, {_S4}, {_ECE4}, m AS ({_metrics_sql('cm', 'event_id')}), j AS (SELECT m.*, ece FROM m JOIN ece4 USING (event_id)),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS metric, {c} AS v FROM j" for c in ('miou', 'macro_f1', 'f1_localization', 'f1_damage', 'ece'))})
SELECT metric, round(avg(v), 6) AS event_macro, round(CASE WHEN metric = 'ece' THEN max(v) ELSE min(v) END, 6) AS worst_event, round(stddev_pop(v), 6) AS std FROM long GROUP BY metric""",
    "disaster_lookup": f"""{with_sql('pixels')}, {_CM}, m AS ({_metrics_sql('cm', 'event_id')}) SELECT event_id, coalesce(lower(r_name), 'unknown') AS disaster_type, round(accuracy, 6) AS accuracy
FROM m LEFT JOIN region ON r_regionkey = event_id WHERE event_id IS NOT NULL""",
    "ece_reliability": f"""{with_sql('scored_buildings')}, {_P3}, {_S3}, b AS (SELECT {_bin('confidence')} AS bin, count(*) AS n, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS a, avg(confidence) AS c FROM s3 GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count, round(i / 15.0::DOUBLE, 6) AS bin_lower, round((i + 1) / 15.0::DOUBLE, 6) AS bin_upper, round(coalesce(a, 0), 6) AS accuracy, round(coalesce(c, 0), 6) AS confidence FROM range(15) t(i) LEFT JOIN b ON b.bin = i""",
    "pixel_ece": f"{with_sql('pixels')}, {_P4}, {_S4}, {_ECE4} SELECT event_id, round(ece, 6) AS ece FROM ece4",
    "building_scores": f"{with_sql('scored_buildings')}, {_P3}, {_S3}, m AS ({_scores_sql('s3', '', '1')}) SELECT n_buildings, round(nll, 6) AS nll, round(brier, 6) AS brier, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM m",
    "temperature_grid": with_sql("scored_buildings") + " " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, round(avg(-ln(greatest(({softmax_sql('logits', 3, str(t))})[target + 1], 1e-12))), 6) AS nll FROM scored_buildings" for t in GRID),
    "bootstrap_ci_event": f"""{with_sql('pixels')}, {_CM}, ev AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS e FROM (SELECT DISTINCT event_id FROM pixels)),
draws AS (SELECT d AS draw, CAST(floor({sql_uniform("'bootstrap42:' || d || ':' || s")} * (SELECT count(*) FROM ev)) AS BIGINT) AS e FROM range({DRAWS}) t(d), range((SELECT count(*) FROM ev)) u(s)),
cells AS (SELECT draw, target, pred, sum(n) AS n FROM draws JOIN ev USING (e) JOIN cm ON cm.event_id = ev.event_id GROUP BY 1, 2, 3),
m AS ({_metrics_sql('cells', 'draw')}), long AS ({' UNION ALL '.join(f"SELECT '{c}' AS metric, {c} AS v FROM m" for c in ('macro_f1', 'miou', 'f1_localization', 'f1_damage'))})
SELECT metric, CAST((SELECT count(*) FROM ev) AS INTEGER) AS n_units, true AS available, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM long GROUP BY metric""",
    "bootstrap_ci_building": f"""{with_sql('scored_buildings')}, {_P3}, {_S3}, {_BOOT}, m AS ({_scores_sql('picked', 'draw', '1')}),
g AS (SELECT draw, sum(abs(h - c)) / sum(n) AS ece FROM (SELECT draw, {_bin('confidence')} AS bin, sum(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS h, sum(confidence) AS c, count(*) AS n FROM picked GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT m.*, ece FROM m JOIN g USING (draw)), long AS ({' UNION ALL '.join(f"SELECT '{c}' AS metric, {c} AS v FROM j" for c in calibration.METRICS)})
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM long GROUP BY metric""",
    "component_aggregate": f"{with_sql('component_pixels')} SELECT component, count(*) AS pixel_count, {', '.join(f'round(avg(logits[{k + 1}]), 6) AS logit_{k}' for k in range(3))} FROM component_pixels GROUP BY 1",
    "component_probabilities": f"""{with_sql('component_pixels')}, q AS (SELECT component, {softmax_sql('logits', 3)} AS p FROM component_pixels),
m AS (SELECT component, count(*) AS n, avg(p[1]) AS a, avg(p[2]) AS b, avg(p[3]) AS c FROM q GROUP BY 1)
SELECT 'tile_building_' || lpad(CAST(component AS VARCHAR), 6, '0') AS building_id, n AS pixel_count, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM m""",
    "majority_class": f"""{with_sql('component_pixels')} SELECT component, label AS target_class_id FROM (
  SELECT component, label, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, label) AS r FROM component_pixels GROUP BY 1, 2) WHERE r = 1""",
    "building_rows": f"""{with_sql('component_pixels')}, a AS (SELECT component, count(*) AS n, [avg(logits[1]), avg(logits[2]), avg(logits[3])] AS z FROM component_pixels GROUP BY 1),
t AS (SELECT component, label FROM (SELECT component, label, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, label) AS r FROM component_pixels GROUP BY 1, 2) WHERE r = 1),
s AS (SELECT component, n, label, {softmax_sql('z', 3)} AS p FROM a JOIN t USING (component))
SELECT (component % 8) || ':' || (component % 100) || ':' || component AS building_id, n AS pixel_count, label AS target_class_id, ['intact', 'damaged', 'destroyed'][list_position(p, list_max(p))] AS predicted_class,
  round(p[2] + 2 * p[3], 6) AS expected_severity, round(-(p[1] * ln(greatest(p[1], 1e-12)) + p[2] * ln(greatest(p[2], 1e-12)) + p[3] * ln(greatest(p[3], 1e-12))) / ln(3), 6) AS predictive_entropy FROM s""",
    "buildings_per_mask": f"{with_sql('component_pixels')} SELECT component % 100 AS tile_id, count(DISTINCT component) AS n_buildings FROM component_pixels WHERE label > 0 GROUP BY 1",
    "lovasz_metric": f"""{with_sql('pixels')}, {_P4}, l AS (SELECT event_id, k AS cls, CASE WHEN target = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fg, round(p[k + 1], 9) AS prob FROM p4, range(4) t(k)),
e AS (SELECT *, abs(fg - prob) AS err, sum(fg) OVER (PARTITION BY event_id, cls) AS total FROM l),
c AS (SELECT *, sum(fg) OVER w AS seen, sum(1 - fg) OVER w AS others FROM e WINDOW w AS (PARTITION BY event_id, cls ORDER BY err DESC, fg DESC ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, 1 - (total - seen) / greatest(total + others, 1) AS jac FROM c),
d AS (SELECT event_id, cls, err, total, jac - coalesce(lag(jac) OVER (PARTITION BY event_id, cls ORDER BY err DESC, fg DESC, jac), 0) AS step FROM j),
b AS (SELECT event_id, cls, sum(err * step) AS loss FROM d WHERE total > 0 GROUP BY 1, 2) SELECT event_id, round(avg(loss), 6) AS lovasz FROM b GROUP BY 1""",
}
