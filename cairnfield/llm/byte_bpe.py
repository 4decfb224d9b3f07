"""Byte-level BPE: encoding by folding ranked merges, decoding by joining the pieces of ids.

``fold_words`` encodes distinct words: a higher-order fold starts from a word's single bytes and,
step by step, joins the leftmost pair of lowest rank; the ranks come from a literal map, held in
buckets because Spark searches one map from end to end. Every distinct word of the corpus is
folded once. Documents are dealt into buckets, each of which asks for its different words once;
the ids come back to the bucket, where its texts are put together from them. There too the ids are
decoded, by joining their binary pieces, and hashed, so that no array of ids has to leave the
task; ``decode`` does the same to a column of ids with higher-order functions only.

The fold copies its array at each step, so a word costs the square of its length. Words of more
than ``LONG_BYTES`` take the same merges in the same order from a heap.

Defined results: a null text is an empty one, with no ids; ids are those of ordinary text, so
the strings of special tokens have no special meaning; repeated rows are encoded alike; an empty
table gives no rows; columns with the name of a result are replaced, others stay.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import buckets as bucketed
from cairnfield.llm import textops
from cairnfield.llm.common import ship

BUCKETS = 1 << 14
#: Beyond this length the pairs wait in a heap.
LONG_BYTES = 128
#: Documents that are handed on at once.
BATCH = 500
#: Texts of a bucket. Its words and chunks stand in a worker's memory several times over.
TEXT_BYTES = 32 << 20
#: Fixed value: the pattern for which a space begins a match, unless white space is on both its sides.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the merges of ``fold_words``, with the pairs in a heap."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, last = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != last:
            continue
        gone[j] = 1
        end[i], after[i] = last, after[j]
        if after[i] < n:
            before[after[i]] = i
        for first, second in ((before[i], i), (i, after[i])):
            if first >= 0 and second < n:
                rank = ranks.get(word[first : end[second]])
                if rank is not None:
                    heapq.heappush(heap, (rank, first, end[second]))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def literal_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal (Spark folds it): BUCKETS small maps of hexadecimal piece to rank."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def _rank(buckets: Column, piece: Column) -> Column:
    return F.get(buckets, F.crc32(piece).bitwiseAND(BUCKETS - 1).cast("int"))[F.hex(piece)]


def _let(value: Column, kind: str, body) -> Column:
    """body, of type kind, of a value that is computed once (a lambda's variable stands for it).

    Not an element of a transform: taking one derives the type of the whole body at each step.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, one: body(one))


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", most: int | None = None) -> DataFrame:
    """Add ids (array of int) to each row of a binary column, by higher-order functions only.

    ``most``: longer words get null. The fold carries the pieces, between two nulls, and the ranks of
    their pairs; a step joins two pieces and looks up the two pairs that are new.
    """

    def folded(whole: Column, buckets: Column) -> Column:
        none, state = F.array().cast("array<int>"), "struct<p: array<binary>, r: array<int>>"
        rest = F.lit(1 << 30)  # all that follow

        def step(acc: Column, _: Column) -> Column:
            p, r = acc["p"], acc["r"]

            def merged(at: Column) -> Column:
                def around(one: Column) -> Column:
                    new = F.array(_rank(buckets, F.concat(F.get(p, at - 2), one)), _rank(buckets, F.concat(one, F.get(p, at + 1))))
                    return F.struct(
                        F.concat(F.slice(p, 1, at - 1), F.array(one), F.slice(p, at + 2, rest)).alias("p"),
                        F.concat(F.slice(r, 1, at - 2), new, F.slice(r, at + 2, rest)).alias("r"),
                    )

                return F.when(at.isNull(), acc).otherwise(_let(F.concat(F.get(p, at - 1), F.get(p, at)), state, around))

            return _let(F.array_position(r, F.array_min(r)).cast("int"), state, merged)

        n, edge = F.length(whole), F.array(F.lit(None).cast("binary"))
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(whole, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(2), n), lambda i: _rank(buckets, F.substring(whole, i - 1, F.lit(2))))
        no_rank = F.array(F.lit(None).cast("int"))
        first = F.struct(F.concat(edge, single, edge).alias("p"), F.concat(no_rank, F.when(n > 1, pairs).otherwise(none), no_rank).alias("r"))
        pieces = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), first, step, lambda acc: F.slice(acc["p"], 2, F.size(acc["p"]) - 2))
        ids = F.when(n == 0, none).when(n > F.lit((1 << 31) - 1 if most is None else most), F.lit(None))
        return _let(_rank(buckets, whole), "array<int>", lambda rank: F.when(rank.isNotNull(), F.array(rank)).otherwise(ids.otherwise(F.transform(pieces, lambda p: _rank(buckets, p)))))

    return words.withColumn("ids", _let(literal_ranks(ranks), "array<int>", lambda buckets: folded(F.col(f"`{word}`"), buckets)))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for: the binary pieces one after the other."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))  # concat takes no array


class Splitter:
    """Cuts texts into chunks that can be split into words on their own.

    With the pattern SPACED these are the pieces between single spaces; they repeat, so most of a
    bucket is split by looking a chunk up. Any other text or pattern is one chunk.
    """

    def __init__(self, pattern: str):
        import regex

        self.words = regex.compile(pattern).findall
        self.mixed = regex.compile(r"\s (?=\s|\Z)").search if pattern == SPACED else lambda _: True

    def chunks(self, text: str) -> tuple[str, list[str]]:
        """The first chunk, and the others without the space before each of them."""
        if self.mixed(text):
            return text, []
        first, *rest = text.split(" ")
        return first, rest

    def joined(self, chunks: set[str], most: int = 10_000):
        """Texts with the words of the chunks: a space before each, and many in one text where that changes no match."""
        some = []
        for chunk in chunks:
            if not chunk or chunk[0].isspace():
                yield " " + chunk
                continue
            some.append(chunk)
            if len(some) == most:
                yield " " + " ".join(some)
                some = []
        yield "".join(" " + chunk for chunk in some)


def _asked(dealt: DataFrame, n: int, pattern: str) -> DataFrame:
    """Packs of each bucket's different words."""

    def ask(batches):
        splitter = Splitter(pattern)
        now, found, chunks = None, set(), set()
        for bucket, batch in bucketed.runs(batches):
            if bucket != now:
                yield out(splitter, now, found, chunks)
                now, found, chunks = bucket, set(), set()
            for body in textops.unsqueezed(batch.column("body")):
                first, rest = splitter.chunks(body.decode())
                found.update(splitter.words(first))
                chunks.update(rest)
        yield out(splitter, now, found, chunks)

    def out(splitter, bucket, found, chunks):
        for some in splitter.joined(chunks):
            found.update(splitter.words(some))
        words = sorted(w.encode() for w in found)  # neighbours alike: smaller packs
        place = np.fromiter((zlib.crc32(w) % n for w in words), dtype=np.int64, count=len(words))
        packs = ((k, [words[i] for i in of.tolist()]) for k, of in bucketed.sliced(place, n))
        return bucketed.batch_of([(k, bucket, textops.listed(some), None) for k, some in packs])

    return dealt.sortWithinPartitions("bucket").mapInArrow(ask, bucketed.PACKS)


class Coder(dict):
    """Ids (as bytes) of chunks without the space before them.

    A word that begins with a space is a chunk and stands here from the start; other chunks are
    put together from their words when first met.
    """

    def __init__(self, splitter: Splitter):
        self.splitter, self.known = splitter, {}

    def learn(self, word: str, ids: bytes) -> None:
        if word[:1] == " ":
            self[word[1:]] = ids
        else:
            self.known[word] = ids

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.words(" " + chunk)
        return ids

    def words(self, text: str) -> bytes:
        return b"".join([self[w[1:]] if w[:1] == " " else self.known[w] for w in self.splitter.words(text)])

    def encode(self, text: str) -> bytes:
        first, rest = self.splitter.chunks(text)
        return self.words(first) + b"".join(map(self.__getitem__, rest))


def _distinct(asked: DataFrame) -> DataFrame:
    """slice and word of each different word in the packs, the words of a slice one after the other."""

    def merge(batches):
        now, found = None, set()
        for place, batch in bucketed.runs(batches, "slice"):
            if place != now:
                yield from out(now, found)
                now, found = place, set()
            for keys in batch.column("keys"):
                found.update(textops.unlisted(keys.as_buffer()))
        yield from out(now, found)

    def out(place, found):
        words = sorted(found)
        for at in range(0, len(words), 10_000):
            some = pa.array(words[at : at + 10_000], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place, dtype=np.int32)), some], ["slice", "word"])

    return asked.sortWithinPartitions("slice").mapInArrow(merge, "slice int, word binary")


def _table(folded: DataFrame, ranks) -> DataFrame:
    """Packs of words and their ids; ranks: broadcast, for the words that the fold leaves out."""

    def pack(batches):
        for batch in batches:
            for place, run in bucketed.runs([batch], "slice"):
                words, ids = run.column("word").to_pylist(), []
                for word, some in zip(words, run.column("ids"), strict=True):
                    own = some.values.to_numpy() if some.is_valid else np.array(fold_long(word, ranks.value))
                    ids.append(own.astype(np.uint32).tobytes())
                yield bucketed.batch_of([(place, bucketed.TABLE, textops.listed(words), textops.listed(ids))])

    return folded.mapInArrow(pack, bucketed.PACKS)


def _answered(asked: pa.Table, table: pa.Table) -> pa.Table:
    """The packs of one slice with the ids of their words."""
    known: dict[bytes, bytes] = {}
    for keys, values in zip(table["keys"], table["n"], strict=True):
        known.update(zip(textops.unlisted(keys.as_buffer()), textops.unlisted(values.as_buffer()), strict=True))
    ids = (textops.listed([known[w] for w in textops.unlisted(keys.as_buffer())]) for keys in asked["keys"])
    return asked.set_column(asked.schema.get_field_index("n"), "n", pa.array(ids, pa.binary()))


class Digests:
    """What is told of a text's ids: their number, the hash of their decimals, the hash of what they decode to."""

    SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.decimals = [str(i) for i in range(len(self.pieces))]

    def decoded(self, ids: list[int]) -> bytes:
        """The pieces of the ids one after the other."""
        return b"".join(map(self.pieces.__getitem__, ids))

    def of(self, coded: list[bytes]) -> list[pa.Array]:
        rows = []
        for some in coded:
            ids = np.frombuffer(some, dtype=np.uint32).tolist()
            decimal = ",".join(map(self.decimals.__getitem__, ids)).encode()
            rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]


def encode_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """The rows with ``ids`` (array of int), or with the columns of ``Digests``, in place of their text."""
    results = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
    ship(docs.sparkSession)
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in docs.columns if c not in (text, *results)]
    others = [F.col(f"`{c}`") for c in kept]
    rows = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *others).alias("row"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_buckets = bucketed.count(docs, size, TEXT_BYTES)
    n_slices = bucketed.slices(n_buckets)
    dealt = bucketed.dealt(rows, n_buckets)
    asked = _asked(dealt, n_slices, pattern).repartition(n_buckets, "slice")
    table = _table(fold_words(_distinct(asked), ranks, most=LONG_BYTES), shared)
    answers = asked.groupBy("slice").cogroup(table.groupBy("slice")).applyInArrow(_answered, bucketed.PACKS)

    def encode(own: pa.Table, found: pa.Table) -> pa.Table:
        coder, batches = Coder(Splitter(pattern)), []
        digest = Digests(shared.value) if digests else None
        for keys, values in zip(found["keys"], found["n"], strict=True):
            for word, ids in zip(textops.unlisted(keys.as_buffer()), textops.unlisted(values.as_buffer()), strict=True):
                coder.learn(word.decode(), ids)
        for batch in own.to_batches(max_chunksize=BATCH):
            coded = [coder.encode(body.decode()) for body in textops.unsqueezed(batch.column("body"))]
            if digests:
                columns = digest.of(coded)
            else:
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))]
            batches.append(pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *results]))
        return pa.Table.from_batches(batches)

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {Digests.SCHEMA if digests else 'ids array<int>'}"
    coded = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(encode, schema)
    return coded.select(*[F.col(f"row.`{c}`") for c in kept], *results)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """The rows with n_tokens, ids_sha256 and decoded_sha256; ``ids``: also with the ids and the decoded bytes.

    The text itself is not carried along.
    """
    if not ids:
        names = [c for c in docs.columns if c not in (text, "ids", "decoded")]
        return encode_ids(docs.select(*[F.col(f"`{c}`") for c in {**dict.fromkeys(names), text: None}]), path, pattern, text, digests=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = encode_ids(docs, path, pattern, text).withColumn("decoded", decode(F.col("ids"), read_ranks(path)))
    return rows.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(decimal, 256), "decoded_sha256": F.sha2("decoded", 256)})
