"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents' blocks.

The words of all documents are cut into blocks at anchors: of each window of ``window`` words
the anchor is its run of ``ANCHOR_WORDS`` words with the smallest hash, and the windows that
share an anchor form a block. Equal windows have equal anchors, so wherever a passage is
repeated its blocks are too, apart from those at its two ends. The index holds every block of
every document, by anchor and by the hash of the whole block, with the place of a reference.

Each document is parsed greedily from left to right. A factor begins at the first window that the
index knows, and points to a document and a position there; it is extended block by block, and
window by window where a block isn't known whole but its anchor is, for as long as the reference
goes on alike. Windows at the boundaries of factors are looked up on their own, so a word is
removed exactly if it lies in a window whose words also start somewhere else, in the same document
or another one. The reference of a passage is the document that comes first by a hash of its
id and text, or for that document the one that comes last.

Everything is keyed by pairs of independent 64-bit hashes (anchor and block, anchor and window).
Counts are pre-aggregated before they are shuffled, and rows come back through joins whose
large partitions Spark splits, so a passage that a third of the documents share is no hot task.

Defined results: a null text has no words; a text shorter than a window keeps all its words;
repeated rows count as different occurrences, so they lose what they share, and each has the
factors of a single row, which refer to the row itself; an empty table gives no rows; columns of the input other than id and text are not read, unless they are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import textops
from cairnfield.llm.common import ship, written

WINDOW = 35
ANCHOR_WORDS = 8
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Bits of a place among the words of a chunk; the other bits of a key hold its hash.
PLACE_BITS = np.uint64(28)


def _rolling_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` entries."""
    reach, out = 1, key
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(key) - width + 1], out[width - reach :]) if width > reach else out


class Parsed:
    """The words of some texts, their hashes, and hashes of any run of them."""

    def __init__(self, texts: pa.Array):
        data, at = textops.raw(texts)
        starts, ends, self.of = textops.words(data, at)
        self.hashes = textops.word_hashes(data, starts, ends)
        n = len(self.hashes)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.hashes * textops.powers(textops.RUN_BASE, n)[:n], out=self.total[1:])
        self.back = textops.powers(textops.inverse(textops.RUN_BASE), n + 1)

    def run(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the words from first to last (not included)."""
        with np.errstate(over="ignore"):
            return textops.mix64((self.total[last] - self.total[first]) * self.back[first] + textops.mix64((last - first).astype(np.uint64)))

    def blocks(self, window: int, k: int) -> tuple[np.ndarray, ...]:
        """Of each block: text, first window within the text, windows, anchor hash, block hash."""
        n = len(self.hashes)
        if n < window:
            return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        grams = self.run(np.arange(n - k + 1), np.arange(k, n + 1))
        place = np.arange(len(grams), dtype=np.uint64)
        least = _rolling_min(((grams >> PLACE_BITS) << PLACE_BITS) | place, window - k + 1)
        anchor = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))
        whole = owner[: n - window + 1] == owner[window - 1 :]
        at = np.flatnonzero(whole)
        if not len(at):
            return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
        first = at[fresh]
        count = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        text = owner[first]
        return text, first - self.of[text], count, grams[anchor[first]], self.run(first, first + count - 1 + window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def block_table(rows: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """Every block of every text: anchor, block, doc_id, check, start, n (windows)."""

    def parse(batches):
        for batch in batches:
            texts = textops.as_strings(batch.column("text"))
            for first, last in textops.chunks(texts):
                text, start, n, anchor, block = Parsed(texts.slice(first, last - first)).blocks(window, k)
                of = pa.array(text + first)
                columns = [_signed(anchor), _signed(block), batch.column("doc_id").take(of), batch.column("check").take(of), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "block", "doc_id", "check", "start", "n"])

    return rows.mapInArrow(parse, "anchor long, block long, doc_id long, check long, start int, n int")


def _other(*names: str) -> list[Column]:
    """The columns under other values, one for one. A join on them deals both sides out anew, and
    only then can Spark split a large partition of the longer side."""
    return [F.col(c).bitwiseXOR(F.lit(1)).alias(f"__{c}") for c in names]


def _semi(rows: DataFrame, keys: DataFrame, names: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is among the keys. If no key is repeated, ``inner`` does the same, and isn't
    moved below a grouping of the rows, as Spark does with a semi join."""
    marked = rows.select("*", *_other(*names))
    return marked.join(keys.select(*_other(*names)), [f"__{c}" for c in names], how).select(*rows.columns)


def _order() -> Column:
    """A number for each place: documents by a hash, and the places of a document in order."""
    return F.shiftleft(F.hash("doc_id", "check").cast("long"), 32).bitwiseOR(F.col("start").cast("long"))


def _places() -> list[Column]:
    """The first and the last place of a group of equal rows."""
    order = _order()
    first, last = F.min(order).alias("first"), F.max(order).alias("last")
    return [F.count("*").alias("count"), first, last, F.min_by("doc_id", order).alias("first_id"), F.max_by("doc_id", order).alias("last_id")]


def _referred(rows: DataFrame, found: DataFrame, names: list[str], how: str) -> DataFrame:
    """Add ref_id and ref_start to the rows: where else their like is found (null: nowhere)."""
    marked = rows.select("*", *_other(*names))
    other = found.select(*_other(*names), "first", "last", "first_id", "last_id")
    joined = marked.join(other, [f"__{c}" for c in names], how)
    own = F.col("first") == _order()
    place = F.when(own, F.col("last")).otherwise(F.col("first")).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return joined.select(*rows.columns, F.when(own, F.col("last_id")).otherwise(F.col("first_id")).alias("ref_id"), place.alias("ref_start"))


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """Each window of the blocks in ``ranges``: anchor, w, doc_id, check, start, known."""

    def look(batches):
        for batch in batches:
            texts = textops.as_strings(batch.column("text"))
            ranges = batch.column("ranges")
            for first, last in textops.chunks(texts):
                parsed = Parsed(texts.slice(first, last - first))
                some = ranges.slice(first, last - first)
                of = np.repeat(np.arange(last - first), some.value_lengths().to_numpy())
                flat = some.flatten()
                start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                block = np.repeat(np.arange(len(n)), n)
                at = start[block] + np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
                begin = parsed.of[of[block]] + at
                text = pa.array(of[block] + first)
                columns = [flat.field("anchor").take(pa.array(block)), _signed(parsed.run(begin, begin + window)), batch.column("doc_id").take(text), batch.column("check").take(text), pa.array(at.astype(np.int32)), flat.field("known").take(pa.array(block))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "w", "doc_id", "check", "start", "known"])

    return asked.mapInArrow(look, "anchor long, w long, doc_id long, check long, start int, known boolean")


def duplicate_ranges(rows: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """What is known of each document: doc_id, check, ranges (start, n: windows; ref_id, ref_start)."""
    blocks = written(block_table(rows, window, k), "blocks")
    shared = blocks.groupBy("anchor").count().where("count > 1")
    blocks = _semi(blocks, shared, ["anchor"])
    whole = blocks.groupBy("anchor", "block").agg(*_places()).where("count > 1")
    parsed = written(_referred(blocks, whole, ["anchor", "block"], "left"), "parsed-blocks")
    known = F.col("ref_start").isNotNull()
    factors = parsed.where(known).select("doc_id", "check", "start", "n", "ref_id", "ref_start")
    # at the ends of factors: single windows, and one copy of each indexed block with such an anchor
    open_blocks = parsed.where(~known)
    order = _order()
    first = [F.min_by(c, order).alias(c) for c in ("doc_id", "check", "start", "n")]
    # grouped before the join: a text of one repeated word pair has the same block a thousand times
    copies = parsed.where(known).groupBy("anchor", "block").agg(*first)
    indexed = _semi(copies, open_blocks.select("anchor").distinct(), ["anchor"], "inner")
    names = ["doc_id", "check", "start", "n", "anchor"]
    looked = open_blocks.select(*names, F.lit(False).alias("known")).union(indexed.select(*names, F.lit(True).alias("known")))
    asked = looked.groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "n", "anchor", "known")).alias("ranges"))
    windows = _windows(rows.join(asked, ["doc_id", "check"]), window)
    again = windows.groupBy("anchor", "w").agg(*_places(), F.max("known").alias("known")).where("count > 1 OR known")
    single = _referred(windows.where("NOT known"), again, ["anchor", "w"], "inner")
    # a set: rows that are equal find the same ranges, and each would get those of all
    found = factors.union(single.select("doc_id", "check", "start", F.lit(1).alias("n"), "ref_id", "ref_start"))
    return found.groupBy("doc_id", "check").agg(F.collect_set(F.struct("start", "n", "ref_id", "ref_start")).alias("ranges"))


def parse(start: np.ndarray, n: np.ndarray, ref_id: np.ndarray, ref_start: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors of one document, left to right: start, words, reference, position there.

    Ranges of known windows that follow each other become one factor while the reference goes on.
    No two different ranges have the same start.
    """
    _, by = np.unique(start, return_index=True)
    start, n, ref_id, ref_start = start[by], n[by], ref_id[by], ref_start[by]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1] + n[:-1]) | (ref_id[1:] != ref_id[:-1]) | (ref_start[1:] != ref_start[:-1] + n[:-1])
    first = np.flatnonzero(fresh)
    words = np.add.reduceat(n, first) + window - 1 if len(first) else n
    return list(zip(start[first].tolist(), words.tolist(), ref_id[first].tolist(), ref_start[first].tolist(), strict=True))


def _found_in(texts, ranges, window: int):
    """The words and the factors of each document of a batch."""
    for body, found in zip(texts, ranges, strict=True):
        factors = []
        if found.is_valid and len(found):
            start, n, ref_id, ref_start = (found.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "ref_id", "ref_start"))
            factors = parse(start, n, ref_id, ref_start, window)
        yield body.as_py().split(), factors


def _keyed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """doc_id, check and text; neither part of a row's key is ever null, so that each join deals
    the texts out alike and they share one exchange."""
    body, known = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{key}`").cast("long")
    return docs.select(F.coalesce(known, F.lit(NO_ID)).alias("doc_id"), F.xxhash64(known, body).alias("check"), body.alias("text"), *more)


def factors(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The factors of at least ``window`` words: doc_id, start, n_words, ref_id, ref_start (in words)."""
    ship(docs.sparkSession)
    rows = _keyed(docs, key, text)

    def cut(batches):
        for batch in batches:
            texts, out = textops.as_strings(batch.column("text")).cast(pa.large_binary()), []
            for doc, (_, own) in zip(batch.column("doc_id").to_pylist(), _found_in(texts, batch.column("ranges"), window), strict=True):
                out.extend((doc, *f) for f in own)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_words", "ref_id", "ref_start"])

    found = rows.join(duplicate_ranges(rows, window), ["doc_id", "check"]).mapInArrow(cut, "doc_id long, start long, n_words long, ref_id long, ref_start long")
    return found.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("doc_id", "ref_id")})


RESULT = "doc_id long, n_words long, n_removed long, n_spans long, n_factors long, kept_sha256 string"


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, n_spans, n_factors, kept_sha256.

    ``carry``: other columns of the input that come along as a struct named ``row``; then the kept
    words, joined by one space, do so too, as ``kept`` (a text that loses nothing stays as it is).
    """
    ship(docs.sparkSession)
    more = [] if carry is None else [F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").isNull().alias("none")]
    rows = _keyed(docs, key, text, *more)
    both = rows.join(duplicate_ranges(rows, window), ["doc_id", "check"], "left")

    def cut(batches):
        for batch in batches:
            out = []
            texts = textops.as_strings(batch.column("text")).cast(pa.large_binary())
            found = _found_in(texts, batch.column("ranges"), window)
            for doc, body, (words, own) in zip(batch.column("doc_id").to_pylist(), texts, found, strict=True):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for start, n, _, _ in own:
                    edge[start] += 1
                    edge[start + n] -= 1
                inside = np.cumsum(edge)[:-1] > 0
                spans = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum()) if own else 0
                kept = [words[i] for i in np.flatnonzero(~inside).tolist()] if own else words
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), spans, len(own), hashlib.sha256(joined).hexdigest(), joined if own else body.as_py()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [*[pa.int64()] * 5, pa.string(), pa.large_binary()]
            names = ["doc_id", "n_words", "n_removed", "n_spans", "n_factors", "kept_sha256", "kept"]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            if carry is None:
                yield pa.RecordBatch.from_arrays(arrays[:6], names[:6])
            else:
                arrays[-1] = arrays[-1].cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*arrays, batch.column("row"), batch.column("none")], [*names, "row", "none"])

    schema = RESULT if carry is None else f"{RESULT}, kept string, row {rows.schema['row'].dataType.simpleString()}, none boolean"
    result = both.mapInArrow(cut, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return result if carry is None else result.withColumn("kept", F.when(~(F.col("none") & (F.col("n_words") == 0)), F.col("kept"))).drop("none")
