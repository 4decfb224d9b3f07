"""N-gram Jaccard join with Bayesian pruning of candidates.

The set of a text holds its runs of ``SHINGLE`` words (all its words as one, if it has fewer).
Texts with equal sets collapse to one representative, the one with the smallest id.

1. Each set gets a MinHash signature of ``BANDS`` * ``ROWS`` values. Two sets that agree in a
   whole band are candidates; at similarity 0.8 a pair misses all bands with a chance of 5e-6.
2. Candidates compare their signatures step by step. A pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold is below ``TOLERANCE`` (uniform prior).
3. The survivors' groups are verified exactly: the intersections of all pairs of a group are
   counted by a product of incidence matrices.

No step emits all pairs of a group. Large buckets and groups are cut into chunks of at most
``BLOCK`` members, and of about ``BLOCK_SHINGLES`` shingles where texts are compared, so long
texts make small chunks. Each pair of chunks is a small piece of work of its own; it returns the
number of links of each member, and joins each set of linked members to its smallest. Class ids
follow from those edges. So every link between different sets is verified, counted and kept; a
class of m different near copies costs m squared comparisons, as a count of its links does.

A set is a node with a number of its own; ids of documents are only reported. So an id with
several texts, which then may be in several classes, is no case apart.

Defined results: a null text has no words; a text without words has no set, is a class of its
own and has no links; repeated rows are copies of one class; a row without an id takes part, and
the id of a class of such rows only is null; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import textops
from cairnfield.llm.common import ship, written
from cairnfield.llm.components import connected
from cairnfield.llm.substring_dedup import Parsed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
STEP, TOLERANCE = 48, 1e-7
BLOCK, BLOCK_SHINGLES = 400, 400_000
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 8192
#: Bits of the map of rows whose texts are compared: 2 MB in bitmaps of MAP_BITS, whatever the corpus.
SLOTS, MAP_BITS = 1 << 24, 1 << 15

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, SIZE, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, and where each text's begin (one entry more)."""
    parsed = Parsed(texts)
    size = np.diff(parsed.of)
    count = np.where(size == 0, 0, np.maximum(size - k + 1, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    first = parsed.of[owner] + np.arange(at[-1]) - at[owner]
    return parsed.run(first, np.minimum(first + k, parsed.of[owner + 1])), at


def chunked_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of long texts: only a chunk of them is in work at once."""
    hashes, counts = [np.empty(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for first, last in textops.chunks(texts):
        own, at = shingle_sets(texts.slice(first, last - first))
        hashes.append(own)
        counts.append(np.diff(at))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SIZE MinHash values of 16 bits for each text (zero for one without a set)."""
    out = np.zeros((len(at) - 1, SIZE), dtype=np.uint16)
    filled = np.flatnonzero(np.diff(at))
    if not len(filled):
        return out
    x, begin = (hashes >> np.uint64(32)).astype(np.uint32), at[filled]
    with np.errstate(over="ignore"):
        for k in range(SIZE):
            # the minimum of a large set has few bits left: it is mixed before it is cut
            out[filled, k] = (np.minimum.reduceat((x ^ _B[k]) * _A[k], begin) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After so many values, a pair needs at least so many matches to stay.

    With m of k values equal the posterior of the similarity is Beta(m + 1, k - m + 1), and its
    tail above the threshold is a sum of binomial terms.
    """
    steps = []
    for k in range(STEP, SIZE + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        steps.append((k, m))
    return steps


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, check, a and b (a 128-bit hash of the set), n and signature, of each row."""

    def sketch(batches):
        for batch in batches:
            texts = textops.as_strings(batch.column("text"))
            for first, last in textops.chunks(texts):
                hashes, at = shingle_sets(texts.slice(first, last - first))
                sums = np.zeros((last - first, 3), dtype=np.uint64)
                for i in range(last - first):
                    own = np.sort(hashes[at[i] : at[i + 1]])
                    if len(own):
                        own = own[np.append(True, own[1:] != own[:-1])]
                        sums[i] = own.sum(), textops.mix64(own).sum(), len(own)
                rows = [r.tobytes() for r in signatures(hashes, at)]
                columns = [batch.column("doc_id").slice(first, last - first), batch.column("check").slice(first, last - first), *(pa.array(sums[:, j].copy().view(np.int64)) for j in range(3)), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "check", "a", "b", "n", "sig"])

    return docs.mapInArrow(sketch, "doc_id long, check long, a long, b long, n long, sig binary")


def _band_keys(reps: DataFrame) -> DataFrame:
    def bands(batches):
        seeds = textops.mix64(np.arange(BANDS, dtype=np.uint64))
        for batch in batches:
            sig = _matrix(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(seeds, sig.shape[:2]).copy()
            for r in range(ROWS):
                key = textops.mix64(key ^ sig[:, :, r])
            of = np.repeat(np.arange(len(sig)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column("rep").take(pa.array(of))], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(bands, "key long, rep long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SIZE)


def _blocks(members: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """Members of groups dealt out in pairs of chunks: group, x, y, own (chunk), rep and payload.

    ``members`` has the number of its group's chunks as ``chunks``. A group of m chunks becomes
    m (m + 1) / 2 blocks; each member goes to m of them.
    """
    rows = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", *payload)
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "own", "rep")


def _groups(batches, key: list[str]):
    """The rows of each run of equal keys, as one table; runs may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in key]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(c[first] for c in columns)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _texts_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows with their texts; few texts move that are not chosen.

    A bounded map of bits tells most rows that are not chosen, without an error for those that are;
    the join behind it is exact. It is a shuffle at any size, as ``chosen`` grows with the corpus.
    """
    slot = F.pmod(F.xxhash64("doc_id", "check"), F.lit(SLOTS))
    part, bit = F.shiftright(slot, 15).alias("part"), slot.bitwiseAND(MAP_BITS - 1).cast("long").alias("bit")
    maps = chosen.select(part, bit).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("bit").bitwiseAND(7).cast("int") + 1)) > 0
    found = rows.select("*", part, bit).join(F.broadcast(maps), "part").where(marked)
    return found.select("doc_id", "check", "text").join(chosen.hint("merge"), ["doc_id", "check"])


def _pairs(own: np.ndarray, x: int, y: int):
    """Index pairs of a block: within one chunk, or between its two chunks, in slices of rows."""
    n = len(own)
    if x == y:
        for i in range(n - 1):
            yield np.full(n - 1 - i, i), np.arange(i + 1, n)
    else:
        second = np.flatnonzero(own == y)
        for i in np.flatnonzero(own == x).tolist():
            yield np.full(len(second), i), second


class Forest:
    """Sets of linked members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Each member of a set with the set's smallest id: blocks of one group repeat few others."""
        sets: dict[int, list[int]] = {}
        for i in range(len(self.parent)):
            sets.setdefault(self.root(i), []).append(int(ids[i]))
        return [(min(own), v) for own in sets.values() for v in set(own) - {min(own)}]


def _pruned(blocks: DataFrame) -> DataFrame:
    """Edges (a, b) that join what the Bayesian comparison of signatures leaves."""
    steps = least_matches()

    def compare(batches):
        out: list[tuple[int, int]] = []
        for block in _groups(batches, ["key", "x", "y"]):
            ids, sig = block["rep"].to_numpy(), _matrix(block["sig"].combine_chunks())
            forest = Forest(len(ids))
            for i, j in _pairs(block["own"].to_numpy(), block["x"][0].as_py(), block["y"][0].as_py()):
                matches, done = np.zeros(len(i), dtype=np.int64), 0
                for k, least in steps:
                    matches += (sig[i, done:k] == sig[j, done:k]).sum(1)
                    stay = matches >= least
                    i, j, matches, done = i[stay], j[stay], matches[stay], k
                    if not len(i):
                        break
                forest.link(i, j)
            out.extend(forest.edges(ids))
            if len(out) > 20_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    return blocks.mapInArrow(compare, "a long, b long, links long").select("a", "b")


def _edge_batch(edges: list[tuple[int, int]], links: list[tuple[int, int]] = ()) -> pa.RecordBatch:
    """Edges, and after them numbers of links as rows without a second end."""
    a = [e[0] for e in edges] + [e[0] for e in links]
    b = [e[1] for e in edges] + [None] * len(links)
    n = [0] * len(edges) + [e[1] for e in links]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], ["a", "b", "links"])


def intersections(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all sets, and of the intersection of each two."""
    n = len(at) - 1
    sets = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(n)]
    size = np.array([len(s) for s in sets])
    both = np.zeros((n, n), dtype=np.float32)
    if not size.sum():
        return size, both
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # only what two sets hold counts
    row, shared = np.repeat(np.arange(n), size), count[column] > 1
    row, column = row[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    total = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        part = np.zeros((n, min(COLUMNS, total - begin)), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - begin] = 1
        both += part @ part.T
    return size, both


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """Exact links: edges (a, b) that join linked members, and the number of links of each member."""

    def verify(batches):
        for block in _groups(batches, ["label", "x", "y"]):
            ids = block["rep"].to_numpy()
            first = np.append(True, ids[1:] != ids[:-1])  # repeated rows follow each other
            if not first.all():
                block = block.filter(pa.array(first))
                ids = block["rep"].to_numpy()
            own = block["own"].to_numpy()
            size, both = intersections(*chunked_sets(textops.as_strings(block["text"])))
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            linked &= (both > 0) & ~np.eye(len(ids), dtype=bool)
            if block["x"][0].as_py() != block["y"][0].as_py():
                linked &= own[:, None] != own[None, :]
            forest = Forest(len(ids))
            for i in range(len(ids)):
                j = np.flatnonzero(linked[i])
                if len(j):
                    forest.link(np.full(len(j), i), j)
            degree = linked.sum(1)
            yield _edge_batch(forest.edges(ids), [(int(ids[i]), int(degree[i])) for i in np.flatnonzero(degree)])

    return blocks.mapInArrow(verify, "a long, b long, links long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, check, rep, n_copies, n_links, class_id and first.

    ``check`` is a hash of the text, ``rep`` the smallest id with the same set, ``n_copies`` the
    number of such documents, ``n_links`` the number of different sets within the threshold, and
    ``class_id`` the smallest id of the class that those links build. ``first`` marks the rows with
    the id and text that come first in their class: one row, unless the very same row is repeated.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(body).alias("check"), body.alias("text"))
    sketches = written(_sketches(rows), "sketches")
    place = F.struct((F.col("doc_id") == NO_ID).alias("none"), "doc_id", "check")
    copies = sketches.where("n > 0").groupBy("a", "b", "n").agg(F.min(place).alias("at"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    reps = written(copies.withColumn("rep", F.monotonically_increasing_id()), "representatives")  # rep: the number of the set
    keys = _band_keys(reps)
    hashed = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"h{i}") for i in range(2)]
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), *hashed).where("size > 1")
    sizes = sizes.groupBy("size", "h0", "h1").agg(F.min("key").alias("key"))  # of buckets with equal members one is enough
    # so that both sides are dealt anew
    sizes = sizes.select(F.col("key").bitwiseXOR(F.lit(1)).alias("other"), F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks"))
    members = keys.withColumn("other", F.col("key").bitwiseXOR(F.lit(1))).join(sizes, "other").drop("other")
    members = members.join(reps.select("rep", "sig"), "rep")
    candidates = connected(written(_pruned(_blocks(members, "key", ["sig"])), "candidates")).withColumnRenamed("v", "rep")
    candidates = candidates.join(reps.select("rep", "n", "at"), "rep")
    chunks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    groups = candidates.groupBy("label").agg(chunks.alias("chunks")).select(F.col("label").bitwiseXOR(F.lit(1)).alias("other"), "chunks")
    labelled = candidates.withColumn("other", F.col("label").bitwiseXOR(F.lit(1))).join(groups, "other")
    chosen = written(labelled.select("rep", "label", "chunks", "at.doc_id", "at.check"), "groups")
    found = written(_verified(_blocks(_texts_of(rows, chosen), "label", ["text"]), threshold), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    linked = connected(found.where("b IS NOT NULL")).select(F.col("v").alias("rep"), F.col("label").bitwiseXOR(F.lit(1)).alias("other"))
    tops = linked.join(reps.select("rep", "at"), "rep").groupBy("other").agg(F.min("at").alias("top"))
    classes = linked.select("rep", F.col("other").bitwiseXOR(F.lit(2)).alias("label")).join(tops.select(F.col("other").bitwiseXOR(F.lit(2)).alias("label"), "top"), "label")
    described = reps.drop("sig").join(links, "rep", "left").join(classes.drop("label"), "rep", "left")
    described = described.select(
        F.col("a").bitwiseXOR(F.lit(1)).alias("__a"),
        F.col("b").alias("__b"),
        F.col("n").alias("__n"),
        F.col("at.doc_id").alias("rep"),
        "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("top", "at").alias("top"),
    )
    every = sketches.select("doc_id", "check", F.col("a").bitwiseXOR(F.lit(1)).alias("__a"), F.col("b").alias("__b"), F.col("n").alias("__n"))
    joined = every.join(described, ["__a", "__b", "__n"], "left")
    return joined.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "check",
        F.nullif(F.coalesce("rep", "doc_id"), F.lit(NO_ID)).alias("rep"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.nullif(F.coalesce("top.doc_id", "doc_id"), F.lit(NO_ID)).alias("class_id"),
        F.coalesce((F.col("top.doc_id") == F.col("doc_id")) & (F.col("top.check") == F.col("check")), F.lit(True)).alias("first"),
    )
