"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers of a text are its windows of ``K`` bytes, numbered by occurrence so that a k-mer's
second occurrence is another element than its first. For each of ``SKETCHES`` hash functions
the ``TUPLE`` elements with the smallest hashes are put back into text order, and a hash of that
ordered tuple is one entry of the fingerprint. Moving or replacing a passage changes the order
or the members of tuples; the share of equal entries is the likeness of two texts.

All k-mers of the whole text are numbered, and every hash function takes its smallest over all
the numbered elements, in blocks of ``BLOCK``.

Defined results: a null text is an empty one; all empty texts have the same fingerprint; a text
shorter than a k-mer is one element; equal texts have equal fingerprints; rows with equal ids
follow each other in order of their texts, and rows without an id come before all others; an empty table gives no rows; other columns of the
input are left out, so no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import textops
from cairnfield.llm.common import ship

K, TUPLE, SKETCHES = 8, 2, 32
#: Elements that all hash functions see at once.
BLOCK = 4096
#: Rows of one run of neighbouring ids, about; and most split points that are collected.
RUN_ROWS, MOST_RUNS = 1000, 20_000
#: Stands for a null id.
NO_ID = -(1 << 63)

_SEEDS = textops.mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_LAST = np.uint64((1 << 64) - 1)


def kmers(data: bytes) -> np.ndarray:
    """Each window of K bytes as a number, hashed."""
    if len(data) < K:
        data = data.ljust(K, b"\xff") if data else b""
    n = len(data) - K + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for shift in range(min(K, n)):
        part = np.frombuffer(data, dtype="<u8", count=(len(data) - shift) // K, offset=shift)
        out[shift::K] = part[: len(out[shift::K])]
    return textops.mix64(out)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """For each k-mer, how many equal ones come before it in the text."""
    n = len(hashes)
    low = np.uint64((1 << n.bit_length()) - 1)
    packed = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))  # a plain sort is much faster than argsort
    by = (packed & low).astype(np.int64)
    alike = (packed[1:] ^ packed[:-1]) <= low
    if not alike.any():
        return np.zeros(n, dtype=np.uint64)
    ordered = hashes[by]
    same = ordered[1:] == ordered[:-1]
    if (alike & ~same).any():  # different hashes with equal upper bits may be mixed up
        by = np.argsort(hashes, kind="stable")
        ordered = hashes[by]
        same = ordered[1:] == ordered[:-1]
    first = np.flatnonzero(np.append(True, ~same))
    out = np.empty(n, dtype=np.uint64)
    out[by] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return out


def entries(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a text, as SKETCHES 32-bit numbers, from its k-mers' hashes in order."""
    if not len(hashes):
        return np.zeros(SKETCHES, dtype=np.uint32)
    size, rows = min(TUPLE, len(hashes)), np.arange(SKETCHES)
    least, place = np.empty((SKETCHES, 0), dtype=np.uint64), np.empty((SKETCHES, 0), dtype=np.int64)
    with np.errstate(over="ignore"):
        element = textops.mix64(hashes + occurrences(hashes) * _SEEDS[0])
        element ^= element >> np.uint64(31)
        for begin in range(0, len(element), BLOCK):
            drawn = element[None, begin : begin + BLOCK] * _SEEDS[:, None]
            for _ in range(min(size, drawn.shape[1])):
                at = drawn.argmin(axis=1)
                least = np.column_stack([least, drawn[rows, at]])
                place = np.column_stack([place, at + begin])
                drawn[rows, at] = _LAST
            if least.shape[1] > size:  # the smallest so far, against this block's
                kept = np.argsort(least, axis=1, kind="stable")[:, :size]
                least, place = np.take_along_axis(least, kept, 1), np.take_along_axis(place, kept, 1)
        chosen = np.sort(place, axis=1)
        total = np.zeros(SKETCHES, dtype=np.uint64)
        for k in range(size):
            total = textops.mix64(total * _SEEDS[1] + hashes[chosen[:, k]])
    return (total >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    return entries(kmers(text.encode()))


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each row's text, as hexadecimal digits."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([as_hex(fingerprint(t)) for t in textops.as_strings(texts).to_pylist()], pa.string())

    return docs.withColumn(out, of(F.col(f"`{text}`")))


def edited(text: str, following: str) -> str:
    """The last quarter of the characters gives way to as many of the next text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _runs(docs: DataFrame, key: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Split points of the ids, and for each run of ids the smallest id, with the run before it.

    Both lists have one entry for each run at most; the ids alone are read for them.
    """
    n = docs.count()
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    cuts = docs.select(F.percentile_approx(key, [i / runs for i in range(1, runs)], 100 * runs).alias("c")).first()["c"] if runs > 1 else []
    cuts = sorted(set(cuts or []))
    starts = {r["run"]: r["first"] for r in docs.groupBy(_run(F.col(key), cuts).alias("run")).agg(F.min(key).alias("first")).collect()}
    order = sorted(starts)
    return cuts, [(starts[run], order[i - 1]) for i, run in enumerate(order)]


def _run(key: Column, cuts: list[int]) -> Column:
    """How many split points lie below the id."""
    points = np.array(cuts, dtype=np.int64)

    @F.arrow_udf("int")
    def bisect(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(points, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int32))

    return bisect(key)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and compare with the next text in order of id.

    The rows are dealt in runs of neighbouring ids. The first text of each run is also sent to
    the run before it, the very first one to the last run, so each task finds all it needs.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cuts, firsts = _runs(rows, "doc_id")
    run = _run(F.col("doc_id"), cuts)
    before = F.create_map(*[F.lit(v) for pair in firsts for v in pair]) if firsts else F.create_map().cast("map<bigint,int>")
    copies = F.when(
        F.col("doc_id").isin([f for f, _ in firsts]),
        F.array(F.struct(run.alias("run"), F.lit(False).alias("tail")), F.struct(before[F.col("doc_id")].cast("int").alias("run"), F.lit(True).alias("tail"))),
    ).otherwise(F.array(F.struct(run.alias("run"), F.lit(False).alias("tail"))))
    dealt = rows.withColumn("to", F.explode(copies)).select("to.run", "to.tail", "doc_id", "text")
    dealt = dealt.repartition("run").sortWithinPartitions("run", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compare, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _compare(batches):
    """Rows in order of run, tails last: each row's successor is the row after it in its run."""
    waiting = None  # run, id, text, sketch
    done: list[tuple] = []

    def flush():
        columns = list(zip(*done, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for run, tail, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = text.as_py()
            sketch = fingerprint(text)
            if waiting is not None and waiting[0] == run:
                _, own_key, own, own_sketch = waiting
                changed = edited(own, text)
                other = own_sketch if changed == own else fingerprint(changed)
                done.append((own_key, len(own), hashlib.sha256(changed.encode()).hexdigest(), as_hex(own_sketch), as_hex(other), likeness(own_sketch, other), likeness(own_sketch, sketch)))
            waiting = None if tail else (run, key, text, sketch)
            if len(done) >= 500:
                yield flush()
    yield flush()
