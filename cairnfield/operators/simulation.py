"""Monte Carlo over decision cells with one vector for each cell: an entry is one simulation.

Buildings are drawn where they are read and summed into their cell's vector, so what is shuffled are
cells and not cells times simulations. Cells then stay in chunks. The limits of each simulation come
from counts of its different sums; for ranks, chunks send one pack for each simulation (and range of scores,
where there are many cells), and get one back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.arrays import uniform_rows
from cairnfield.operators import priority
from cairnfield.operators.iterate import kept
from cairnfield.sources.files import ship

#: Cells of a chunk, of the vectors that a task sums before it hands them on, and of a range of ranks, about.
CHUNK, HELD, RANGE = 4_096, 4_096, 1_000_000
#: Buildings whose draws are made at once.
DRAWN = 512
#: Cells of the sample that cuts the ranges.
SAMPLE = 4_096
PLACES = 12


def _vectors(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([v.tobytes() for v in rows.values()], pa.binary())], names=["cell", "sums"])


def cell_vectors(buildings: DataFrame, simulations: int, seed: int, multiplier: float, building: str) -> DataFrame:
    """(cell, sums): the severities of each cell's buildings in every simulation; a task may give a cell several times."""
    total = F.col("p_intact") + F.col("p_damaged") + F.col("p_destroyed")
    one = F.col("p_intact") / total
    rows = buildings.where("cell IS NOT NULL").select(F.col("cell").cast("long").alias("cell"), F.col(building).cast("string").alias("b"), one.alias("c1"), (one + F.col("p_damaged") / total).alias("c2"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, names = batch.column("cell").to_pylist(), batch.column("b").to_pylist()
            c1, c2 = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("c1", "c2"))  # a null is no limit, as NaN
            for first in range(0, len(cells), DRAWN):
                rows = slice(first, first + DRAWN)
                u = uniform_rows(f"mc{seed}", names[rows], simulations)
                severity = np.where(u > c2[rows], multiplier, np.where(u > c1[rows], 1.0, 0.0))
                for cell, one in zip(cells[rows], severity, strict=True):
                    if cell in held:
                        held[cell] += one
                    else:
                        held[cell] = one.copy()
            if len(held) > HELD:
                yield _vectors(held)
                held = {}
        yield _vectors(held)

    return rows.mapInArrow(draw, "cell long, sums binary")


CHUNKS = "chunk int, cells binary, scores binary, raw binary"


def chunked(cells: DataFrame, vectors: DataFrame, n: int, simulations: int, weights: dict[str, float]) -> DataFrame:
    """(chunk, cells, scores, raw): the static part of each cell's score and its vector, many cells a row."""
    parts = max(1, -(-n // CHUNK))
    names = [k for k in priority.NAMES[1:] if k in weights]
    static = cells.select(F.col("cell").cast("long").alias("cell"), *[F.col(f"{k}_score").cast("double").alias(k) for k in names], F.lit(None).cast("binary").alias("sums"))
    summed = vectors.select("cell", *[F.lit(None).cast("double").alias(k) for k in names], "sums")
    place = F.pmod(F.hash("cell"), F.lit(parts)).cast("int").alias("chunk")
    both = static.select(place, "*").union(summed.select(place, "*"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, sums = None, {}, {}

        def done() -> pa.RecordBatch:
            order = sorted(known)
            empty = np.zeros(simulations)
            columns = [np.array(order, dtype=np.int64), np.array([known[c] for c in order], dtype=np.float64), np.array([sums.get(c, empty) for c in order])]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=["chunk", "cells", "scores", "raw"])

        for batch in batches:
            statics = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True))
            for i, (chunk, cell) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
                if chunk != now:
                    if known:
                        yield done()
                    now, known, sums = chunk, {}, {}
                vector = batch.column("sums")[i]
                if vector.is_valid:
                    v = np.frombuffer(vector.as_py())
                    sums[cell] = sums[cell] + v if cell in sums else v
                else:
                    known[cell] = statics[i]
        if known:
            yield done()

    return both.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(gather, CHUNKS)


def _opened(row: dict, simulations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = np.frombuffer(row["cells"], np.int64)
    return cells, np.frombuffer(row["scores"]).reshape(len(cells), -1), np.frombuffer(row["raw"]).reshape(len(cells), simulations)


def limits(chunks: DataFrame, simulations: int, lower: float, upper: float) -> np.ndarray:
    """The two quantiles of every simulation's sums over all cells, exact: (simulations, 2) numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, raw = _opened(row, simulations)
                found = [np.unique(raw[:, s], return_counts=True) for s in range(simulations)]
                sims = np.repeat(np.arange(simulations, dtype=np.int32), [len(v) for v, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(sims), pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([n for _, n in found]))], names=["sim", "v", "n"])

    counted = chunks.mapInArrow(count, "sim int, v double, n long").groupBy("sim", "v").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("sim").agg(F.percentile("v", F.array(F.lit(lower), F.lit(upper)), F.col("n")).alias("q")).collect()  # one for each simulation
    out = np.zeros((simulations, 2))
    for r in rows:
        out[r.sim] = r.q
    return out


def scores_of(static: np.ndarray, raw: np.ndarray, ends: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Scores of a chunk: the sums between their limits, and the other components, in the order of NAMES."""
    low, high = ends[:, 0], ends[:, 1]
    span = np.where(high > low, high - low, 1.0)
    out = weights["damage"] * np.where(high > low, np.clip((raw - low) / span, 0.0, 1.0), 0.0)
    for i, k in enumerate(k for k in priority.NAMES[1:] if k in weights):
        out = out + weights[k] * static[:, [i]]
    return out


def uncertainty(cells: DataFrame, buildings: DataFrame, simulations: int, seed: int = 42, weights: dict[str, float] | None = None, multiplier: float = priority.DESTROYED_MULTIPLIER, lower: float = priority.LOWER, upper: float = priority.UPPER, building: str = "building_id", fraction: float = priority.TOP_FRACTION, in_range: int = RANGE) -> DataFrame:
    """The same rows as ``priority.uncertainty`` of ``priority.monte_carlo``: of each cell (whose static scores aren't null),
    mean and 5, 50, 95 % points of the score, mean and 5, 95 % of the rank, and the share of top ranks.
    """
    ship(cells.sparkSession)
    weights = weights or priority.available_weights()
    n = cells.count()
    top = max(1, math.ceil(fraction * n))
    chunks = kept(chunked(cells, cell_vectors(buildings, simulations, seed, multiplier, building), n, simulations, weights))
    ends = limits(chunks, simulations, lower, upper)
    cuts = _cuts(chunks, simulations, ends, weights, n, in_range)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, static, raw = _opened(row, simulations)
                scores = np.round(scores_of(static, raw, ends, weights), PLACES)
                out = []
                for s in range(simulations):
                    of = np.zeros(len(ids), dtype=np.int64)
                    for score, cell in cuts[s]:  # behind so many cuts in falling order
                        of += (scores[:, s] < score) | (scores[:, s] == score) & (ids > cell)
                    for r in np.unique(of).tolist():
                        at = np.flatnonzero(of == r)
                        out.append((s, r, row["chunk"], len(at), at.astype(np.int32).tobytes(), ids[at].tobytes(), scores[at, s].tobytes()))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sim", "part", "chunk", "n", "at", "cells", "scores"])

    sent = kept(chunks.mapInArrow(send, "sim int, part int, chunk int, n long, at binary, cells binary, scores binary"))
    before = Window.partitionBy("sim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("sim", "part").agg(F.sum("n").alias("n")).select("sim", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    asked = sent.join(starts, ["sim", "part"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs = None, []

        def done() -> pa.RecordBatch:
            ids, scores = np.concatenate([np.frombuffer(p["cells"], np.int64) for p in packs]), np.concatenate([np.frombuffer(p["scores"]) for p in packs])
            ranks = np.empty(len(ids), dtype=np.int64)
            ranks[np.lexsort((ids, -scores))] = np.arange(len(ids)) + packs[0]["start"] + 1
            edge = np.cumsum([0, *[p["n"] for p in packs]])
            rows = [ranks[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([p["chunk"] for p in packs], pa.int32()), pa.array([p["sim"] for p in packs], pa.int32()), pa.array([p["at"] for p in packs], pa.binary()), pa.array(rows, pa.binary())], names=["chunk", "sim", "at", "ranks"])

        for batch in batches:
            for p in batch.to_pylist():
                if (p["sim"], p["part"]) != now:
                    if packs:
                        yield done()
                    now, packs = (p["sim"], p["part"]), []
                packs.append(p)
        if packs:
            yield done()

    ranked = asked.repartition("sim", "part").sortWithinPartitions("sim", "part").mapInArrow(rank, "chunk int, sim int, at binary, ranks binary")
    none = F.lit(None)
    packs = ranked.select("chunk", "sim", "at", "ranks", none.cast("binary").alias("cells"), none.cast("binary").alias("scores"), none.cast("binary").alias("raw"))
    own = chunks.select("chunk", F.lit(-1).alias("sim"), none.cast("binary").alias("at"), none.cast("binary").alias("ranks"), "cells", "scores", "raw")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done() -> pa.RecordBatch:
            ids, scores, ranks = state
            q = lambda x, p: np.percentile(x, p, axis=1) if len(ids) else np.empty(0)
            columns = [ids, scores.mean(axis=1), q(scores, 5), q(scores, 50), q(scores, 95), ranks.mean(axis=1), q(ranks, 5), q(ranks, 95), (ranks <= top).mean(axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=NAMES)

        for batch in batches:
            for r in batch.to_pylist():
                if r["sim"] < 0:  # a chunk comes before its ranks
                    if state is not None:
                        yield done()
                    ids, static, raw = _opened(r, simulations)
                    state = ids, scores_of(static, raw, ends, weights), np.empty(raw.shape)
                else:
                    state[2][np.frombuffer(r["at"], np.int32), r["sim"]] = np.frombuffer(r["ranks"], np.int64)
        if state is not None:
            yield done()

    tasks = max(1, -(-n // CHUNK))
    met = own.union(packs).repartition(tasks, "chunk").sortWithinPartitions("chunk", "sim")
    return met.mapInArrow(describe, ", ".join(f"{c} {'long' if c == 'cell' else 'double'}" for c in NAMES))


NAMES = ["cell", "priority_mean", "priority_p05", "priority_p50", "priority_p95", "rank_mean", "rank_p05", "rank_p95", "prob_top_10_percent"]


def _cuts(chunks: DataFrame, simulations: int, ends: np.ndarray, weights: dict[str, float], n: int, in_range: int) -> list[list[tuple[float, int]]]:
    """Of each simulation, the (score, cell) behind which a new range of ranks begins, in falling order; from a bounded sample."""
    ranges = -(-n // in_range)
    if ranges <= 1:
        return [[] for _ in range(simulations)]
    share = max(1, -(-n // SAMPLE))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, static, raw = _opened(row, simulations)
                some = slice(row["chunk"] % share, None, share)
                scores = np.round(scores_of(static[some], raw[some], ends, weights), PLACES)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([s.tobytes() for s in scores], pa.binary())], names=["cell", "scores"])

    got = chunks.mapInArrow(sample, "cell long, scores binary").limit(4 * SAMPLE).toArrow()
    ids = got["cell"].to_numpy()
    scores = np.array([np.frombuffer(v.as_py()) for v in got["scores"]]).reshape(len(ids), simulations)
    out = []
    for s in range(simulations):
        by = np.lexsort((ids, -scores[:, s]))
        at = by[[len(by) * k // ranges for k in range(1, ranges)]] if len(by) else []
        out.append([(float(scores[i, s]), int(ids[i])) for i in at])
    return out
