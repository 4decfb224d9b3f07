import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"
SMALL = {"block": 40, "group": 8, "sample": 60, "leaf": 16}


def brute(rows, anchor, positives=5, negatives=10, scale=256):
    """The rows that ``mine`` should give, one comparison at a time, in Python's own integers."""
    seen, usable = set(), []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(float(np.float32(x)) for x in v)
        if (i, label, v) not in seen:
            seen.add((i, label, v))
            usable.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, row in enumerate(usable):
        if row[0] is None or not anchor(row[0]):
            continue
        score = [max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(row[2], other[2])))) for other in usable]
        same = sorted(((s, o[0]) for b, (s, o) in enumerate(zip(score, usable)) if b != a and o[1] == row[1]), key=order)[:positives]
        far = sorted(((s, o[0]) for s, o in zip(score, usable) if o[1] != row[1]), key=order)
        for p, pid in same:
            fits = [x for x in far if 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(row[0], pid, r + 1, n, p, s) for r, (s, n) in enumerate(fits)]
    return Counter(out)


def mined(spark, rows, every=10, schema=SCHEMA, **sizes):
    table = spark.createDataFrame(rows, schema)
    return Counter(tuple(r) for r in hard_negatives.mine(table, F.col("id") % every == 0, **(SMALL | sizes)).collect())


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_mining_matches_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(400):
        v = rng.normal(size=12) if kind == "spread" else centres[i % 6] + 0.05 * rng.normal(size=12)
        if kind == "ties":
            v = rng.integers(-1, 3, size=3)
        rows.append((i, int(rng.integers(3)), [float(x) for x in v]))
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, block=1000, group=1000, sample=10_000) == want


def test_mining_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), [rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(60, None, [1.0, 1.0, 1.0, 1.0]), (70, 1, None), (80, 1, [1.0, None, 0.0, 0.0]), (90, 0, [1.0, math.nan, 0.0, 0.0]), (100, 0, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(110, 0, [0.5, 0.5]), (120, 1, []), (None, 1, [0.6, 0.6, 0.6, 0.6]), (None, 0, [0.6, 0.6, 0.6, 0.6]), (10, 1, [0.9, 0.1, 0.1, 0.1])]
    rows += rows[:20]  # repeated rows
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "tag", "cell", "part", "score", "rank", "anchor")})
    got = hard_negatives.mine(clashing, F.col("id") % 10 == 0, **SMALL)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).count() == 0


def test_mining_of_enormous_numbers_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [float(np.float32(rng.choice([1e5, 3e6, 1e13]) * rng.random())) for _ in range(3)]) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_one_common_vector_is_split_over_blocks(spark):
    rows = [(i, i % 3, [0.5, 0.25, 0.125] if i % 3 else [random.Random(i).random() for _ in range(3)]) for i in range(900)]
    table = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.col("embedding").alias("vector"))
    search = hard_negatives.Mine(table, F.col("id") % 100 == 0, 256, **SMALL)
    sizes = [len(r.ids) // 8 for r in search.blocks().collect()]
    assert sum(sizes) == 900 and max(sizes) < 3 * SMALL["block"]
    assert mined(spark, rows, every=100) == brute(rows, lambda i: i % 100 == 0)


def test_far_groups_are_pruned_together():
    rng = np.random.default_rng(1)
    near, far = 1000 + rng.normal(size=(64, 8)), -1000 + rng.normal(size=(64, 8))
    anchors, _ = hard_negatives.grow(np.rint(near), 8)
    rows, _ = hard_negatives.grow(np.rint(np.concatenate([near, far])), 8)
    nodes = len(anchors.rows)
    for node, leaves in hard_negatives.pairs(anchors, rows, np.zeros(nodes), np.full(nodes, np.inf)):
        assert anchors.leaf(node) and all((rows.rows[leaf] < 64).all() for leaf in leaves)
        assert sum(len(rows.rows[leaf]) for leaf in leaves) == 64
