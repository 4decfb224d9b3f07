import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cairnfield.llm import sharding
from cairnfield.llm.sharding import Leaf, planned, shard_of


def placed(spark, tree, n=4000):
    rows = spark.range(n).select("id", shard_of(F.col("id").cast("string"), tree).alias("shard")).collect()
    return {r.id: r.shard for r in rows}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (40, 41, 47):
        before, after = placed(spark, planned(n)), placed(spark, planned(n + 1))
        moved = {k for k in before if before[k] != after[k]}
        assert moved and {after[k] for k in moved} == {n}
        assert abs(len(moved) - 4000 / (n + 1)) < 60


def test_weights_decide_the_shares(spark):
    tree = [Leaf("a", "x", 0, 1.0), Leaf("a", "x", 1, 3.0), Leaf("a", "y", 2, 2.0), Leaf("b", "x", 3, 4.0), Leaf("b", "x", 4, 0.0)]
    n = Counter(placed(spark, tree, 10_000).values())
    assert n[4] == 0
    for shard, share in ((0, 0.1), (1, 0.3), (2, 0.2), (3, 0.4)):
        assert abs(n[shard] / 10_000 - share) < 0.02


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    tree = planned(40)
    heavier = [Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    region = {x.shard: x.region for x in tree}
    before, after = placed(spark, tree), placed(spark, heavier)
    for k in before:
        if before[k] != after[k]:  # into the heavier region, or within it towards the heavier rack or shard
            assert region[after[k]] == region[5]
            if region[before[k]] == region[5]:
                assert after[k] == 5 or after[k] // 4 == 1
    swapped = [Leaf(x.region, x.rack, x.shard, {5: 1.5, 6: 0.5}.get(x.shard, 1.0)) for x in tree]
    after = placed(spark, swapped)
    assert {before[k] // 4 for k in before if before[k] != after[k]} == {1}  # one rack, whose own weight is the same


def test_slots_are_gapless_on_odd_rows(spark, odd_docs, no_docs):
    many = odd_docs.unionByName(odd_docs).withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "key", "n", "part", "first")})
    rows = sharding.shards(many, planned(40), planned(41)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in many.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.shards(no_docs, planned(40), planned(41)).count() == 0


def test_many_equal_rows_are_counted_before_they_are_numbered(spark):
    n = 3 * sharding.REPEATS + 7
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shards(docs, planned(40), planned(41)).agg(F.count("*"), F.countDistinct("slot"), F.max("slot"), F.countDistinct("shard")).first()
    assert tuple(got) == (n, n, n - 1, 1)
