"""Documents in buckets of bounded size, each of which brings its different keys once.

What a document looks up in a table that grows with the corpus (counts of its words, say) can't
be broadcast, and one row for each of its words is more data than the document. A bucket of
documents has each key once, however often its documents use it. So a bucket's keys meet the
table in a join, the answers come back to the bucket, and its texts are worked on beside them.

The texts are exchanged once, compressed, and that exchange serves every use of ``dealt``. Keys
travel in packs: all keys of a bucket that fall into one slice of the keys' hashes are a row.
A bucket holds about ``BUCKET_BYTES`` of text, or one longer text; rows that are equal in
all columns share a bucket. The bucket depends on nothing but the row, so a lost task finds it again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import textops

BUCKET_BYTES = 64 << 20
#: Most slices of the keys, which bounds the packs of a bucket.
MOST_SLICES = 1 << 14


def count(docs: DataFrame, total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many buckets as the texts need, and at least one for each core."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-total_bytes // bucket_bytes))


def slices(buckets: int) -> int:
    """More slices than tasks, so that the tasks get about the same share of them."""
    return min(8 * buckets, MOST_SLICES)


def sliced(place: np.ndarray, n: int):
    """(slice, indices) of each slice that has any."""
    by = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[by], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, by[edge[k] : edge[k + 1]]


def dealt(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """``text`` gives way to ``body``, its compressed bytes, and the rows of a ``bucket`` share a partition.

    Every use must take all columns: Spark shares an exchange only where none of them is pruned.
    """

    @F.arrow_udf("binary")
    def squeeze(texts: pa.Array) -> pa.Array:
        return textops.squeezed(textops.as_strings(texts))

    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    place = F.pmod(F.xxhash64(*hashed), F.lit(buckets)).cast("int")
    rows = docs.select(place.alias("bucket"), *others, squeeze(F.col(f"`{text}`")).alias("body"))
    return rows.repartition(buckets, "bucket")


def runs(batches, column: str = "bucket"):
    """The batches of sorted rows, cut where the bucket changes: (bucket, batch) in order."""
    for batch in batches:
        keys = batch.column(column).to_numpy()
        edges = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if last > first:
                yield int(keys[first]), batch.slice(first, last - first)


#: A pack: ``slice`` of its keys, ``bucket`` that asks (TABLE: a part of the table), keys, and their values.
PACKS, TABLE = "slice int, bucket int, keys binary, n binary", -1


def batch_of(packs: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*packs, strict=True)) or [[]] * 4
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "bucket", "keys", "n"])


def answered(packs: DataFrame, tasks: int, finder) -> DataFrame:
    """The asking packs with the values of their keys.

    ``finder`` takes a slice and the table's packs of it, (keys, values) pairs, and returns what
    turns the keys of an asking pack into its values. Within a slice the table's packs come first.
    """

    def answer(batches):
        now, table, find = None, [], None
        for place, run in runs(batches, "slice"):
            if place != now:
                now, table, find = place, [], None
            out = []
            for bucket, keys, values in zip(run.column("bucket").to_pylist(), run.column("keys"), run.column("n"), strict=True):
                if bucket == TABLE:
                    table.append((keys.as_buffer(), values.as_buffer()))
                    continue
                if find is None:
                    find, table = finder(place, table), []
                out.append((place, bucket, keys.as_py(), find(keys.as_buffer())))
            yield batch_of(out)

    return packs.repartition(tasks, "slice").sortWithinPartitions("slice", "bucket").mapInArrow(answer, PACKS)
