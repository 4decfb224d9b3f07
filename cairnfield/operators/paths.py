"""Shortest paths from many sources, block by block.

Nodes are ordered (places by Z-order, other nodes by themselves) and cut into blocks of about as many
nodes each. A round takes the blocks that have news at their border, settles each one whole by
a priority queue, and sends on only what crosses into other blocks. So rounds grow with the blocks
on a path and not with its edges, and a round reads and writes the blocks that it concerns.

Costs are a log: a round appends the nodes of its blocks whose cost fell, and after some rounds the log is
merged. Nothing that is settled is written again.

All tables of the loop are packs: (block, kind, keys, values), a node's key being its block and its
number there. A node's edges meet in its block's task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnfield.operators.iterate import kept, released
from cairnfield.sources.files import ship
from cairnfield.sources.geometry import z_order

#: Nodes of a block, rounds between merges of the log, and tasks of a round at most.
BLOCK_NODES, MERGE_EVERY, MOST_TASKS = 50_000, 8, 4_096
EDGES, KNOWN, NEWS = 0, 1, 2
PACK = "block int, kind int, keys binary, values binary"


def settle(first: np.ndarray, to: np.ndarray, weight: np.ndarray, cost: np.ndarray, news: np.ndarray) -> np.ndarray:
    """Lower ``cost`` from the nodes in ``news`` on, along edges first[i]:first[i + 1] of node i; returns the nodes that fell.

    ``to`` is below zero where an edge leaves the block.
    """
    queue = [(cost[i], i) for i in news.tolist()]
    heapq.heapify(queue)
    fell = set(news.tolist())
    while queue:
        d, i = heapq.heappop(queue)
        if d > cost[i]:
            continue
        for e in range(first[i], first[i + 1]):
            j = to[e]
            if j >= 0 and d + weight[e] < cost[j]:
                cost[j] = d + weight[e]
                fell.add(int(j))
                heapq.heappush(queue, (cost[j], int(j)))
    return np.array(sorted(fell), dtype=np.int64)


def _packs(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (2, 3)]]
    return pa.RecordBatch.from_arrays(columns, names=["block", "kind", "keys", "values"])


def _least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its least value."""
    by = np.lexsort((values, keys))
    keys, values = keys[by], values[by]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[new], values[new]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]]]:
    """Sorted packs, block by block: those of each kind."""
    now, held = None, {}
    for batch in batches:
        for i, (block, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
            if block != now and held:
                yield now, held
                held = {}
            now = block
            keys, values = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("keys", np.int64), ("values", np.float64)))
            held.setdefault(kind, []).append((keys, values))
    if held:
        yield now, held


def _joined(packs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _least(np.concatenate([k for k, _ in packs]), np.concatenate([v for _, v in packs]))


def _news(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Packs of sorted keys by their blocks."""
    edge = np.flatnonzero(np.r_[True, (keys >> 32)[1:] != (keys >> 32)[:-1], True]) if len(keys) else []
    return [(int(keys[a] >> 32), NEWS, keys[a:b], values[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle each block; its fallen costs are KNOWN packs, what leaves it NEWS packs of other blocks."""
    for block, packs in _by_block(batches):
        if NEWS not in packs:
            continue
        here, offered = _joined(packs[NEWS])
        local = here & 0xFFFFFFFF
        # edges: (from, to) in the keys, one behind the other; weights in the values
        pairs = [(k[: len(v)] & 0xFFFFFFFF, k[len(v) :], v) for k, v in packs.get(EDGES, [])]
        source, target, weight = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        if len(weight) and weight.min() < 0:
            raise ValueError("Costs can't be negative")
        inside = target >> 32 == block
        keys, values = _joined(packs[KNOWN]) if KNOWN in packs else (np.empty(0, np.int64), np.empty(0))
        n = int(max(local.max(), source.max(initial=0), (target[inside] & 0xFFFFFFFF).max(initial=0), (keys & 0xFFFFFFFF).max(initial=0))) + 1
        by = np.argsort(source, kind="stable")
        source, target, weight, inside = source[by], target[by], weight[by], inside[by]
        cost = np.full(n, np.inf)
        cost[keys & 0xFFFFFFFF] = values
        better = offered < cost[local]
        if not better.any():
            continue
        cost[local[better]] = offered[better]
        fell = settle(np.searchsorted(source, np.arange(n + 1)), np.where(inside, target & 0xFFFFFFFF, -1), weight, cost, local[better])
        out = [(block, KNOWN, (np.int64(block) << 32) + fell, cost[fell])]
        again = np.zeros(n, dtype=bool)
        again[fell] = True
        leaving = ~inside & again[source]
        yield _packs(out + _news(*_least(target[leaving], cost[source[leaving]] + weight[leaving])))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, packs in _by_block(batches):
        yield _packs([(block, KNOWN, *_joined(packs[KNOWN]))])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, packs in _by_block(batches):
        keys, values = _joined(packs[KNOWN])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], names=["i", "cost"])


def _edge_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, a, b, w), dealt by block, as packs; a block may get several."""
    for batch in batches:
        block, a, b, w = (batch.column(c).to_numpy() for c in ("block", "a", "b", "w"))
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
        rows = [(int(block[i]), EDGES, np.concatenate([a[i:j], b[i:j]]), w[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        if rows:
            yield _packs(rows)


def numbered(names: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(n, i) of different nodes (n): i has the block in its upper and the place in its lower half; and the number of blocks."""
    count = names.count()
    blocks = max(1, -(-count // block))
    kind = names.schema["n"].dataType
    key = F.col("n")
    if isinstance(kind, StructType) and {"x", "y"} <= set(kind.names):
        r = names.agg(*[f(f"n.{c}") for f in (F.min, F.max) for c in "xy"]).first()
        if r[0] is not None:
            key = z_order(F.col("n.x"), F.col("n.y"), tuple(float(v) for v in r))
    dealt = names.withColumn("k", key).repartitionByRange(blocks, "k", "n").withColumn("block", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("block").orderBy("k", "n")) - 1
    return kept(dealt.select("n", (F.shiftleft(F.col("block").cast("long"), 32) + place).alias("i"))), blocks


def distances(graph: DataFrame, sources: DataFrame, cost: str, u: str = "u", v: str = "v", node: str = "node", most_rounds: int | None = None, block: int = BLOCK_NODES) -> DataFrame:
    """Least cost from any source to each node that can be reached over undirected edges: (node, cost).

    A source without edges is reached at no cost. Edges without an end or a cost don't count; negative
    costs are errors. Ends when no block has news; a bound on the rounds that comes before that is an error.
    """
    ship(graph.sparkSession)
    one = graph.select(F.col(u).alias("a"), F.col(v).alias("b"), F.col(cost).cast("double").alias("w")).dropna()
    both = one.union(one.select("b", "a", "w"))
    start = sources.select(F.col(node).alias("n")).where("n IS NOT NULL").distinct()
    names, blocks = numbered(both.select(F.col("a").alias("n")).union(start).distinct(), block)
    tasks = min(blocks, MOST_TASKS)
    a, b = (names.select(F.col("n").alias(c), F.col("i").alias(f"i{c}")) for c in "ab")
    rows = both.join(a, "a").join(b, "b").select(F.shiftright("ia", 32).cast("int").alias("block"), F.col("ia").alias("a"), F.col("ib").alias("b"), "w")
    edges = kept(rows.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_edge_packs, PACK))

    def news_packs(batches):
        for batch in batches:
            keys = np.sort(batch.column("i").to_numpy())
            if len(keys):
                yield _packs(_news(keys, np.zeros(len(keys))))

    def dealt(packs: DataFrame) -> DataFrame:
        return packs.repartition(tasks, "block").sortWithinPartitions("block", "kind")

    news = kept(names.join(start, "n", "left_semi").select("i").mapInArrow(news_packs, PACK))
    known: list[DataFrame] = []
    done = 0
    while news.limit(1).count():
        live = news.select("block").distinct()
        packs = edges.join(live, "block", "left_semi").union(news)
        for k in known:
            packs = packs.union(k.where(F.col("kind") == KNOWN).join(live, "block", "left_semi"))
        out = kept(dealt(packs).mapInArrow(_round, PACK))
        done += 1
        if most_rounds is not None and done > most_rounds and out.where(F.col("kind") == KNOWN).limit(1).count():
            raise RuntimeError(f"Costs still fall after {most_rounds} rounds")
        known.append(out)
        if done == 1:
            released(news)
        news = out.where(F.col("kind") == NEWS)
        if len(known) > MERGE_EVERY:
            log, tail = known[:-1], known[-1:]
            base = log[0].where(F.col("kind") == KNOWN)
            for k in log[1:]:
                base = base.union(k.where(F.col("kind") == KNOWN))
            known = [kept(dealt(base).mapInArrow(_merged, PACK)), *tail]
            for k in log:
                released(k)
    if not known:
        return names.limit(0).select(F.col("n").alias(node), F.lit(0.0).alias("cost"))
    log = known[0].where(F.col("kind") == KNOWN)
    for k in known[1:]:
        log = log.union(k.where(F.col("kind") == KNOWN))
    found = dealt(log).mapInArrow(_unpacked, "i long, cost double")
    return found.join(names, "i").select(F.col("n").alias(node), "cost")
