"""Column expressions that the operators share; all of them stay inside Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of probabilities before a logarithm: metrics and pixel figures.
LOG_FLOOR, FIGURE_FLOOR = 1e-12, 1e-8


def uniform(tag: str | Column, *keys: Column) -> Column:
    """A uniform in [0, 1) that depends on the tag and the keys only, on any cluster."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    text = F.concat_ws(":", tag, *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def seed_token(seed: int, name: Column) -> Column:
    """The first eight bytes of sha256 of ``seed:name``, as hexadecimal digits in text order."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 16)


# tile names


def tile_event(tile_id: Column) -> Column:
    """What stands before the last underscore, if digits follow it; else null."""
    return F.when(tile_id.rlike(r"^.*_[0-9]+$"), F.regexp_extract(tile_id, r"^(.*)_([0-9]+)$", 1))


def tile_ordinal(tile_id: Column) -> Column:
    return F.when(tile_id.rlike(r"^.*_[0-9]+$"), F.regexp_extract(tile_id, r"^(.*)_([0-9]+)$", 2)).cast("long")


def disaster_type(event_id: Column) -> Column:
    """What stands behind the last hyphen of an event."""
    return F.substring_index(event_id, "-", -1)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; other paths unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def absolute_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


# probabilities


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; the greatest logit is subtracted first."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")

    def let(value: Column, body) -> Column:  # a lambda's variable is computed once
        return F.get(F.transform(F.array(value), body), F.lit(0))

    scaled = let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda z: F.exp((z.cast("double") - top) / temperature)))
    return let(scaled, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """Index (from 0) of the first greatest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalised_entropy(p: Column, classes: int, floor: float = LOG_FLOOR) -> Column:
    """Entropy of a probability array divided by that of the uniform distribution."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.ln(F.greatest(x, F.lit(floor)))) / math.log(classes)


def expected_severity(p: Column) -> Column:
    """0, 1 and 2 weighted by the probabilities of intact, damaged and destroyed."""
    return p[1] + 2.0 * p[2]


def nll(p: Column, target: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, target), F.lit(LOG_FLOOR)))


def brier(p: Column, target: Column) -> Column:
    squared = F.transform(p, lambda x, i: (x - F.when(i == target, 1.0).otherwise(0.0)) * (x - F.when(i == target, 1.0).otherwise(0.0)))
    return F.aggregate(squared, F.lit(0.0), lambda a, x: a + x)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z.cast("double") - top))
    return F.transform(logits, lambda z: z.cast("double") - top - F.ln(total))


def dual_heads_to_four_class(location: Column, damage: Column) -> Column:
    """Log probabilities of background and of each damage class of a building."""
    where, what = log_softmax(location), log_softmax(damage)
    return F.concat(F.array(where[0]), F.transform(what, lambda d: where[1] + d))


def dual_head_probabilities(location: Column, damage: Column, temperature: float) -> Column:
    """Background and damage-class probabilities; only the damage head is tempered."""
    where, what = softmax(location), softmax(damage, temperature)
    return F.concat(F.array(where[0]), F.transform(what, lambda d: where[1] * d))


def renormalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / F.greatest(total, F.lit(LOG_FLOOR)))


def valid_probabilities(p: Column) -> Column:
    """All entries finite and not negative, and a positive sum."""
    fine = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce(fine & (F.aggregate(p, F.lit(0.0), lambda a, x: a + x) > 0), F.lit(False))


# scores


def robust_scaled(value: Column, low: Column, high: Column) -> Column:
    """Clipped to [0, 1] between two quantiles; all zero if they coincide. Missing values count as 0."""
    clean = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    span = F.try_divide(clean - low, high - low)
    return F.when(high <= low, 0.0).otherwise(F.least(F.greatest(span, F.lit(0.0)), F.lit(1.0)))


def damage_raw(damaged: Column, destroyed: Column, multiplier: float = 2.0) -> Column:
    return damaged + multiplier * destroyed


def population_raw(population: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(population, F.lit(0.0)), F.lit(0.0)))


def accessibility_penalty(base: Column, risk: Column) -> Column:
    """Relative extra cost in [0, 1]; without a positive finite base cost the cell is isolated: 1."""
    reached = base.isNotNull() & risk.isNotNull() & (base > 0)
    extra = F.try_divide(risk - base, base)
    return F.when(reached, F.least(F.greatest(extra, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)


def bands(score: Column, moderate: Column, high: Column, critical: Column) -> Column:
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= moderate, "MODERATE").otherwise("LOW")


# rasters


def normalised_pixels(pixels: Column, mode: str, mean: Column | None = None, std: Column | None = None) -> Column:
    """none: unchanged; scale_uint: divided by 65535 if any value is over 255, else by 255; zscore: (x - mean) / std."""
    if mode == "none":
        return F.transform(pixels, lambda x: x.cast("double"))
    if mode == "scale_uint":
        top = F.when(F.array_max(pixels) > 255, 65535.0).otherwise(255.0)
        return F.transform(pixels, lambda x: x.cast("double") / top)
    if mode == "zscore":
        safe = F.when(std > 0, std).otherwise(F.raise_error(F.lit("std must be positive")).cast("double"))
        return F.transform(pixels, lambda x: (x.cast("double") - mean) / safe)
    raise ValueError(f"unknown mode {mode}")


def bounds_delta(a: Column, b: Column) -> Column:
    """Greatest absolute difference of two arrays of coordinates."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


# maps


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) % 60 + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS84, by the transverse Mercator series to third order.

    Good to a few millimetres within a zone. Zone exceptions of Norway and Svalbard are not applied.
    """
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + k0 * radius * x, F.when(lat < 0, 1e7).otherwise(0.0) + k0 * radius * y
