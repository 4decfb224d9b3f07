"""Hard-negative mining by dual-tree search over integer inner products.

Candidates and anchors each have a tree of balls. For a pair of nodes, centres and radii bound
every inner product between them; a pair whose interval lies outside what all its anchors can
still use is passed by, whole groups of anchors at once. Leaf pairs are scored exactly.

* A tree of at most ``MOST_CELLS`` leaves is cut on a bounded sample; every row is then put into its
  leaf, a *cell*, and balls are measured over all rows. A cell of many rows is several *blocks*.
* The sample's rows are candidates as well: what an anchor finds among them is where its bounds begin.
* Anchors travel in groups: a group's own tree meets the tree of cells, and the group's anchors that a cell
  may concern go to the blocks of that cell, each of which goes on with a tree of its own.
* A block answers with at most k rows for each anchor and range; ranks over the blocks' answers follow.

The search runs twice: for the positives of each anchor, then for the negatives within the ranges
that the positives' scores allow. Nothing is cut off: bounds only leave out what can't be among the first k.
The anchors are a stated query set; each meets all rows in blocks.

Defined cases: rows with a null label, a null vector or a component that is null or not finite take no
part. Rows equal in id, label and vector count once. Rows that share an id but nothing else
are different rows. A row without an id can be found (its id is null, behind all ids in ties) but is no anchor. A shorter
vector is as one with zeros behind it. Products are exact; one beyond a 64-bit integer counts as the nearest such
integer. Labels are integers. A positive without a negative in its range has no rows. An empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm.buckets import runs
from cairnfield.llm.common import ship, written

#: Rows of the sample (bounded, about), cells, rows of a block and anchors of a group.
SAMPLE, MOST_CELLS, BLOCK, GROUP = 8_192, 1_024, 32_768, 1_024
#: Rows of a leaf: of a block's tree, and of a group's.
LEAF, ANCHOR_LEAF = 1_024, 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
GREATEST = float(np.finfo(np.float64).max)
BLOCKS, ASKS = 0, 1
PACK = pa.schema(
    [("cell", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("ids", "tags", "labels", "vectors", "more")]]
)
PACK_DDL = "cell int, part int, kind int, ids binary, tags binary, labels binary, vectors binary, more binary"
FOUND = "anchor_id long, tag long, place long, score long, id long"


# exact products


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of integral floats, exact, within a 64-bit integer."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if top < 1 << 53:  # every partial sum is a double's integer
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def small(x: np.ndarray) -> bytes:
    """Integral floats in the narrowest kind that holds them, after the kind and the width."""
    top = np.abs(x).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind.encode() + x.shape[1].to_bytes(4, "little") + x.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    kind, width = bytes(data[:3]).decode(), int.from_bytes(data[3:7], "little")
    flat = np.frombuffer(data, dtype=kind, offset=7).astype(np.float64)
    return flat.reshape(-1, width) if width else np.zeros((0, 0))


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, shorter rows filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    flat = np.clip(flat, -GREATEST, GREATEST)
    width = max(1, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


# trees of balls


@dataclass
class Balls:
    """A binary tree: node i has the ball (centre, radius); leaves have no children but a range of ``rows``."""

    centre: np.ndarray
    radius: np.ndarray
    children: np.ndarray  # -1 at leaves
    rows: list[np.ndarray]  # of every node

    def leaf(self, i: int) -> bool:
        return self.children[i, 0] < 0


def cut(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction of great spread, in whole numbers so that products don't depend on their order, and its median."""
    seen = x - x.mean(axis=0)
    way = seen[np.argmax((seen * seen).sum(axis=1))].copy()
    for _ in range(4):
        if not (norm := np.linalg.norm(way)):
            break
        way = seen.T @ (seen @ (way / norm))
    way = np.rint(1024 * way / max(np.linalg.norm(way), 1e-300))
    return way, float(np.median(x @ way))


def grow(x: np.ndarray, leaf: int, most: int = 1 << 30) -> tuple[Balls, list[tuple[np.ndarray, float] | None]]:
    """A tree over the rows of ``x`` with leaves of about ``leaf`` rows and at most ``most`` leaves; and each inner node's cut."""
    rows, children, cuts, queue, leaves = [np.arange(len(x))], [[-1, -1]], [None], [0], 1
    while queue:  # level by level, so that a bound of leaves leaves an even tree
        i = queue.pop(0)
        own = rows[i]
        if len(own) <= leaf or leaves >= most:
            continue
        way, middle = cut(x[own])
        left = x[own] @ way <= middle
        if left.all() or not left.any():
            left = x[own] @ way < middle
        if left.all() or not left.any():  # nothing but equal rows along the cut
            continue
        cuts[i] = (way, middle if (x[own[left]] @ way == middle).any() else np.nextafter(middle, -np.inf))
        for side in (left, ~left):
            children[i][0 if side is left else 1] = len(rows)
            queue.append(len(rows))
            rows.append(own[side])
            children.append([-1, -1])
            cuts.append(None)
        leaves += 1
    centre = np.array([x[r].mean(axis=0) if len(r) else np.zeros(x.shape[1]) for r in rows])
    radius = np.array([np.sqrt(((x[r] - c) ** 2).sum(axis=1).max(initial=0)) for r, c in zip(rows, centre, strict=True)])
    return Balls(centre, radius, np.array(children), rows), cuts


def interval(a: Balls, i, b: Balls, j) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between two balls, a little wide for rounding."""
    ca, cb = a.centre[i], b.centre[j]
    na, nb = np.linalg.norm(ca, axis=-1), np.linalg.norm(cb, axis=-1)
    ra, rb = a.radius[i], b.radius[j]
    middle, reach = (ca * cb).sum(axis=-1), na * rb + nb * ra + ra * rb
    slack = reach + 1 + 1e-9 * (na + ra) * (nb + rb)
    return middle - slack, middle + slack


def pairs(a: Balls, b: Balls, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Of each leaf of ``a``, the leaves of ``b`` that may hold a product between its ``low`` and ``high``, nearest first.

    ``low`` and ``high`` are the least and the greatest score that any anchor below a node of ``a`` can use.
    """
    met: dict[int, list[tuple[float, int]]] = {}
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        least, most = interval(a, i, b, j)
        if most < low[i] or least > high[i]:
            continue
        if a.leaf(i) and b.leaf(j):
            met.setdefault(i, []).append((-float(most + least), j))
        elif b.leaf(j) or not a.leaf(i) and a.radius[i] >= b.radius[j]:
            stack += [(k, j) for k in a.children[i].tolist()]
        else:
            stack += [(i, k) for k in b.children[j].tolist()]
    for i, found in met.items():
        yield i, [j for _, j in sorted(found)]


# anchors and their ranges


@dataclass
class Asks:
    """Anchors with the ranges they ask for: ``lows`` and ``highs`` have a column for each range, ``places`` its name."""

    ids: np.ndarray
    tags: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    places: np.ndarray

    def of(self, rows: np.ndarray) -> Asks:
        return Asks(*(v[rows] for v in (self.ids, self.tags, self.labels, self.x, self.lows, self.highs, self.places)))

    def bounds(self, tree: Balls) -> tuple[np.ndarray, np.ndarray]:
        """The least low and the greatest high below each node; ranges that hold nothing don't count."""
        open_ = self.lows <= self.highs
        low = np.where(open_, self.lows, HIGHEST).min(axis=1)
        high = np.where(open_, self.highs, LOWEST).max(axis=1)
        return np.array([low[r].min(initial=HIGHEST) for r in tree.rows], dtype=np.float64), np.array([high[r].max(initial=LOWEST) for r in tree.rows], dtype=np.float64)


@dataclass
class Rows:
    """Candidates; ``ids`` of rows without one stand behind all others (``unnamed``)."""

    ids: np.ndarray
    unnamed: np.ndarray
    tags: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def first(score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ties by smaller id, rows without one last."""
    keep = np.arange(len(score))
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep[np.lexsort((ids[keep], unnamed[keep], ~score[keep]))][:k]


class Search:
    """The dual-tree search of anchors in one block: the first k rows of each anchor and range, of its label or of others."""

    def __init__(self, rows: Rows, k: int, same: bool, leaf: int = LEAF):
        self.rows, self.k, self.same = rows, k, same
        self.tree, _ = grow(rows.x, leaf)

    def run(self, asks: Asks) -> list[list[np.ndarray]]:
        """Of every anchor and range, (score, row) of its first k here; ``asks.lows`` rises to what is found."""
        n, width = len(asks.ids), max(asks.x.shape[1], self.rows.x.shape[1])
        asks.x, self.rows.x, self.tree.centre = (padded(x, width) for x in (asks.x, self.rows.x, self.tree.centre))
        rows = self.rows
        best = [[np.empty((2, 0), dtype=np.int64) for _ in range(asks.lows.shape[1])] for _ in range(n)]
        group, _ = grow(asks.x, ANCHOR_LEAF)
        for node, leaves in pairs(group, self.tree, *asks.bounds(group)):
            own = group.rows[node]
            for leaf in leaves:
                low = np.where(asks.lows[own] <= asks.highs[own], asks.lows[own], HIGHEST).min(axis=1)
                high = np.where(asks.lows[own] <= asks.highs[own], asks.highs[own], LOWEST).max(axis=1)
                least, most = interval(Balls(asks.x[own], np.zeros(len(own)), None, []), slice(None), self.tree, leaf)
                live = np.flatnonzero(~(most < low) & ~(least > high))  # bounds of enormous numbers may not be numbers
                if not len(live):
                    continue
                there = self.tree.rows[leaf]
                score = products(asks.x[own[live]], rows.x[there])
                use = (score >= low[live, None]) & (score <= high[live, None])
                use &= (rows.labels[there] == asks.labels[own[live], None]) == self.same
                if self.same:
                    use &= rows.tags[there] != asks.tags[own[live], None]
                for i in np.flatnonzero(use.any(axis=1)).tolist():
                    self._add(asks, best, int(own[live[i]]), score[i], there, np.flatnonzero(use[i]))
        return best

    def _add(self, asks: Asks, best: list[list[np.ndarray]], anchor: int, score: np.ndarray, there: np.ndarray, at: np.ndarray) -> None:
        s = score[at]
        for w in range(asks.lows.shape[1]):
            low, high = asks.lows[anchor, w], asks.highs[anchor, w]
            sel = (s >= low) & (s <= high)
            if not sel.any():
                continue
            both = np.concatenate([best[anchor][w], np.stack([s[sel], there[at[sel]]])], axis=1)
            keep = first(both[0], self.rows.ids[both[1]], self.rows.unnamed[both[1]], self.k)
            best[anchor][w] = both[:, keep]
            if len(keep) == self.k:  # an equal score may still win by its id
                asks.lows[anchor, w] = max(low, both[0, keep[-1]])


# packs


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(PACK)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACK, strict=True)], schema=PACK)


def rows_of(batch: pa.RecordBatch, scale: int) -> Rows:
    ids = batch.column("id")
    unnamed = np.asarray(ids.is_null())
    return Rows(ids.fill_null(0).to_numpy().astype(np.int64), unnamed, batch.column("tag").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vector"), scale))


def asks_of(ids, tags, labels, vectors, more) -> Asks:
    whole = np.frombuffer(more, dtype=np.int64)
    n = len(ids) // 8
    lows, highs, places = whole.reshape(3, n, -1).copy() if n else np.empty((3, 0, 1), dtype=np.int64)
    return Asks(*(np.frombuffer(v, dtype=np.int64) for v in (ids, tags, labels)), large(vectors), lows, highs, places)


def packed(asks: Asks) -> tuple:
    return asks.ids.tobytes(), asks.tags.tobytes(), asks.labels.tobytes(), small(asks.x), np.stack([asks.lows, asks.highs, asks.places]).tobytes()


def whole_runs(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Sorted rows by key: batches of one key as one."""
    now, held = None, []
    for batch in batches:
        batch = batch.append_column("__key", pa.array(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys]).T @ np.array([1 << 32, 1])[-len(keys) :], pa.int64()))
        for key, run in runs([batch], "__key"):
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = key
            held.append(run)
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Mine:
    """The prepared tables of one search, and its two passes."""

    def __init__(self, table: DataFrame, anchors: Column, scale: int, block: int | None = None, group: int = GROUP, sample: int = SAMPLE, leaf: int = LEAF):
        """``table`` is (id, label, vector) without repeats; ``anchors`` says which rows are anchors."""
        spark = table.sparkSession
        ship(spark)
        self.spark, self.scale, self.group, self.leaf = spark, scale, group, leaf
        tag = F.xxhash64("id", "label", "vector")
        rows = written(table.select("id", "label", "vector", tag.alias("tag"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")
        self.n, self.n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
        if not self.n_anchors:
            return
        self.tasks = spark.sparkContext.defaultParallelism
        self.block = block or min(BLOCK, max(1_024, -(-self.n // (4 * self.tasks))))
        some = rows.where(F.pmod("tag", F.lit(1 << 20)) < max(1, (1 << 20) * sample // self.n)).limit(2 * sample)
        taken = some.select("id", "label", "vector", "tag").toArrow().combine_chunks().to_batches()
        self.sample = rows_of(taken[0], scale) if taken else Rows(*(np.empty(0, t) for t in (np.int64, bool, np.int64, np.int64)), np.zeros((0, 1)))
        cells = min(MOST_CELLS, max(1, -(-self.n // self.block)))
        self.tree, self.cuts = grow(self.sample.x, max(1, len(self.sample.x) // (2 * cells)), cells)
        self._place(rows)

    def _place(self, rows: DataFrame) -> None:
        """Every row into its cell, with the distance from the cell's centre; then the balls over all rows."""
        tree, cuts, scale = self.tree, self.cuts, self.scale

        def route(batches):
            for batch in batches:
                x = matrix(batch.column("vector"), scale)
                width = max(x.shape[1], tree.centre.shape[1])
                x, centre = np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(tree.centre, ((0, 0), (0, width - tree.centre.shape[1])))
                at, moving = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
                while moving:
                    i, own = moving.pop()
                    at[own] = i
                    if cuts[i] is not None and len(own):
                        way, middle = cuts[i]
                        left = (x[own, : len(way)] * way).sum(axis=1) <= middle
                        moving += [(int(tree.children[i, 0]), own[left]), (int(tree.children[i, 1]), own[~left])]
                far = np.sqrt(((x - centre[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        self.rows = written(rows.mapInArrow(route, rows.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",cell:int,far:double"), "cells")
        of_cell = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if("anchor").alias("anchors")).collect()  # MOST_CELLS rows at most
        self.parts = np.ones(len(tree.rows), dtype=np.int64)
        anchors, radius = np.zeros(len(tree.rows), dtype=np.int64), np.full(len(tree.rows), -1.0)
        for r in of_cell:
            self.parts[r.cell], radius[r.cell], anchors[r.cell] = -(-r.n // self.block), r.far, r.anchors
        for i in reversed(range(len(tree.rows))):  # a ball around the children's balls
            if not tree.leaf(i):
                below = [k for k in tree.children[i].tolist() if radius[k] >= 0]
                radius[i] = max((float(np.linalg.norm(tree.centre[i] - tree.centre[k])) + radius[k] for k in below), default=-1.0)
                anchors[i] = anchors[tree.children[i]].sum()
        tree.radius = np.where(radius < 0, 0.0, radius) * (1 + 1e-9) + 1e-6
        self.empty = radius < 0
        # anchors travel by the highest nodes that hold no more than a group
        self.node, stack = np.zeros(len(tree.rows), dtype=np.int64), [(0, -1)]
        while stack:
            i, above = stack.pop()
            above = above if above >= 0 else i if anchors[i] <= self.group or tree.leaf(i) else -1
            self.node[i] = above
            stack += [] if tree.leaf(i) else [(k, above) for k in tree.children[i].tolist()]
        self.groups = np.maximum(1, -(-anchors // self.group))

    def _spread(self, cell: Column, of: np.ndarray) -> Column:
        """The value of ``of`` at a cell's number; a literal list of at most twice MOST_CELLS entries."""
        return F.get(F.array(*[F.lit(int(v)) for v in of]), cell)

    def blocks(self) -> DataFrame:
        part = F.pmod("tag", self._spread(F.col("cell"), self.parts)).cast("int")
        rows = self.rows.select("cell", part.alias("part"), "id", "tag", "label", "vector")
        scale = self.scale

        def pack(batches):
            for key, run in whole_runs(batches, ("cell", "part")):
                r = rows_of(run, scale)
                yield batch_of([(key >> 32, key & 0xFFFFFFFF, BLOCKS, r.ids.tobytes(), r.tags.tobytes(), r.labels.tobytes(), small(r.x), r.unnamed.tobytes())])

        dealt = rows.repartition("cell", "part").sortWithinPartitions("cell", "part")
        return written(dealt.mapInArrow(pack, PACK_DDL), "blocks")

    def search(self, anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, tag, place, score, id): at most k rows of each block for each anchor and range.

        ``anchors`` has, besides the columns of rows, ``ranges``: an array of (low, high, place).
        """
        tree, parts, empty, sample, scale, leaf = self.tree, self.parts, self.empty, self.sample, self.scale, self.leaf
        node = self._spread(F.col("cell"), self.node)
        dealt = anchors.withColumn("node", node.cast("int"))
        share = F.pmod(F.hash("tag"), self._spread(F.col("node"), self.groups)).cast("int")
        dealt = dealt.select("node", share.alias("share"), "id", "tag", "label", "vector", F.col("ranges.low").alias("low"), F.col("ranges.high").alias("high"), F.col("ranges.place").alias("place"))

        def ask(batches):
            known = Search(sample, k, same, leaf) if len(sample.ids) else None
            for _, run in whole_runs(batches, ("node", "share")):
                sizes = run.column("low").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.arange(max(1, int(sizes.max(initial=0)))) < sizes[:, None]
                ranges = []
                for name, none in (("low", HIGHEST), ("high", LOWEST), ("place", 0)):
                    out = np.full(at.shape, none, dtype=np.int64)
                    out[at] = run.column(name).flatten().to_numpy(zero_copy_only=False)
                    ranges.append(out)
                r = rows_of(run, scale)
                asks = Asks(r.ids, r.tags, r.labels, r.x, *ranges)
                if known:
                    known.run(asks)  # raises the lows
                group, _ = grow(padded(asks.x, tree.centre.shape[1]), ANCHOR_LEAF)
                cells = Balls(padded(tree.centre, group.centre.shape[1]), tree.radius, tree.children, tree.rows)
                to: dict[int, list[np.ndarray]] = {}
                for i, leaves in pairs(group, cells, *asks.bounds(group)):
                    for c in leaves:
                        if not empty[c]:
                            to.setdefault(c, []).append(group.rows[i])
                for c, own in to.items():
                    body = packed(asks.of(np.concatenate(own)))
                    for p in range(int(parts[c])):
                        yield batch_of([(c, p, ASKS, *body)])

        asking = dealt.repartition("node", "share").sortWithinPartitions("node", "share").mapInArrow(ask, PACK_DDL)

        def answer(batches):
            now, block = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["kind"] == BLOCKS:
                        now = (r["cell"], r["part"])
                        ids, tags, labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "tags", "labels"))
                        block = Search(Rows(ids, np.frombuffer(r["more"], dtype=bool), tags, labels, large(r["vectors"])), k, same, leaf)
                        continue
                    if (r["cell"], r["part"]) != now:  # a part that the hash left without rows
                        continue
                    asks = asks_of(*(r[c] for c in ("ids", "tags", "labels", "vectors", "more")))
                    best = block.run(asks)
                    yield found_batch(asks, best, block.rows)

        meeting = blocks.union(asking).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return meeting.mapInArrow(answer, FOUND)


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def found_batch(asks: Asks, best: list[list[np.ndarray]], rows: Rows) -> pa.RecordBatch:
    at = [(i, w, b) for i, ranges in enumerate(best) for w, b in enumerate(ranges) if b.shape[1]]
    sizes = [b.shape[1] for *_, b in at]
    who = np.repeat(np.array([i for i, *_ in at], dtype=np.int64), sizes)
    which = np.repeat(np.array([w for _, w, _ in at], dtype=np.int64), sizes)
    score, row = np.concatenate([b for *_, b in at], axis=1) if at else np.empty((2, 0), dtype=np.int64)
    columns = [asks.ids[who], asks.tags[who], asks.places[who, which], score]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(rows.ids[row], pa.int64(), mask=rows.unnamed[row])], names=["anchor_id", "tag", "place", "score", "id"])


def usable(vector: Column) -> Column:
    """Whether every component is a finite number."""
    fits = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & fits


def mine(
    table: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    **sizes: int,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of every anchor, its first ``positives`` other rows of its label; of each of these, the first
    ``negatives`` rows of other labels whose score is between ``least`` and ``most`` hundredths of the positive's.
    """
    named = table.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"))
    rows = named.where(F.col("label").isNotNull() & usable(F.col("vector"))).dropDuplicates()
    kept_anchor = anchors & F.col("id").isNotNull()
    spark = table.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    search = Mine(rows, kept_anchor, scale, **sizes)
    if not search.n_anchors:
        return spark.createDataFrame([], out)
    blocks = search.blocks()
    asking = search.rows.where("anchor")
    anything = F.array(F.struct(F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"), F.lit(0).cast("long").alias("place")))

    def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy("anchor_id", "tag", *by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = written(ranked(search.search(asking.withColumn("ranges", anything), blocks, positives, True), positives).drop("place"), "positives")
    # 100 * n between least * p and most * p, in whole numbers of any size
    p = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(p * least / 100), F.floor(p * most / 100)
    ranges = near.select("anchor_id", "tag", F.col("score").alias("place"), low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high").distinct()
    wanted = ranges.groupBy("anchor_id", "tag").agg(F.collect_list(F.struct("low", "high", "place")).alias("ranges"))
    asking = asking.join(wanted, (F.col("id") == F.col("anchor_id")) & asking["tag"].eqNullSafe(wanted["tag"])).select(*[asking[c] for c in asking.columns], "ranges")
    far = ranked(search.search(asking, blocks, negatives, False), negatives, "place")
    far = far.select("anchor_id", "tag", F.col("place").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_id", "tag", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(far, ["anchor_id", "tag", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
