"""Shards by a hierarchical weighted hash tree.

A tree of regions, racks and shards has a weight at each shard; a rack and a region weigh what
their shards weigh. A key starts at the root and takes, at each level, the child with the least
draw: an exponential of the key and the child's name, divided by the child's weight. A child's
draw depends on nothing but its own name and weight, so a change of weights moves only keys that
enter or leave the subtrees whose weights change, and between others nothing moves.

A shard that is added inside a rack makes its rack and its region heavier: keys enter the region
and are drawn anew below it. A shard that opens a region of its own changes no other weight: keys
move into it and nowhere else. ``planned`` adds shards in that way, so that its law is ``key``: the
id and the number of shards decide, and one more shard takes rows only into itself.

Defined cases: a null text has no bytes and the crc of none; rows without an id are one key
(the empty text), as equal ids are, so they share a shard. Equal rows take neighbouring slots; they
are counted before they are numbered, so no task holds them all. An empty table gives no rows.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.columns import uniform
from cairnfield.llm.common import written

#: Bytes that each row takes besides its text.
ROW_BYTES = 16
#: Parts of a shard that are numbered on their own, and rows that one step of repeating makes.
SLICES, REPEATS = 4096, 10_000
#: Half a step of ``uniform``, so that no draw is the logarithm of zero.
HALF = 0.5 / (1 << 32)


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def planned(shards: int, base: int = 40, racks: int = 2, each: int = 4) -> list[Leaf]:
    """The first ``base`` shards in regions of ``racks`` racks of ``each`` shards; every later one in a region of its own.

    From ``base`` shards on, one more takes rows only into itself.
    """
    leaves = []
    for s in range(shards):
        rack = s // each
        settled = s < base
        region = f"region-{rack // racks}" if settled else f"region-of-{s}"
        leaves.append(Leaf(region, f"rack-{rack}" if settled else f"rack-of-{s}", s))
    return leaves


def draw(key: Column, name: Column, weight: Column) -> Column:
    """The key's draw at a node: exponential, with the node's weight as its rate."""
    return -F.ln(uniform(name, key) + HALF) / weight


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key that isn't null; shards of no weight get nothing."""
    racks: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in tree:
        if leaf.weight < 0:
            raise ValueError("weights can't be negative")
        if leaf.weight:
            racks[leaf.region][leaf.rack].append(leaf)
    if not racks:
        raise ValueError("no shard has a weight")
    if len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("a shard is in the tree twice")

    def children(nodes: list[tuple[str, float, int]]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(at).alias("at")) for n, w, at in nodes])

    def least(nodes: Column) -> Column:
        drawn = F.transform(nodes, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["at"].alias("at")))
        return F.array_min(drawn)["at"]

    regions = sorted(racks)
    places = [(r, k) for r in regions for k in sorted(racks[r])]
    total = {p: sum(leaf.weight for leaf in racks[p[0]][p[1]]) for p in places}
    level1 = children([(r, sum(total[p] for p in places if p[0] == r), i) for i, r in enumerate(regions)])
    level2 = F.array(*[children([(f"{r}/{k}", total[r, k], places.index((r, k))) for k in sorted(racks[r])]) for r in regions])
    level3 = F.array(*[children([(f"{r}/{k}/{x.shard}", x.weight, x.shard) for x in sorted(racks[r][k], key=lambda x: x.shard)]) for r, k in places])
    return least(F.get(level3, least(F.get(level2, least(level1)))))


def shards(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; slots are gapless from 0 in each shard.

    Slots follow (slice, key, crc, size), where a slice is a hash of key and crc.
    """
    body = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    part = F.crc32(F.concat_ws(":", name, F.col("text_crc32").cast("string")).cast("binary")) % SLICES
    placed = written(counted.select("*", shard_of(name, tree).alias("shard"), shard_of(name, grown).alias("grown_shard"), part.cast("int").alias("part")), "shards")

    sizes = placed.groupBy("shard", "part").agg(F.sum("n").alias("of_part"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("start"))
    above = Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(above), F.lit(0))
    numbered = placed.join(starts, ["shard", "part"]).withColumn("first", first)
    steps = numbered.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(REPEATS))))
    until = F.least(F.col("step") + REPEATS, F.col("n")) - 1
    each = steps.withColumn("k", F.explode(F.sequence("step", until)))
    return each.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), "grown_shard"
    )
