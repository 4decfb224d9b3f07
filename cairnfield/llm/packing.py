"""Packing tokenised documents into sequences: best fit, then a swap-based local search.

Each document becomes its token ids and one closing id. Only documents longer than a sequence
are cut. A piece that fills a sequence is one as it is. The others are counted and dealt by hash
into groups of about ``GROUP_PIECES``; each group is packed by best-fit decreasing, and then its
underfull bins, all of them, exchange pieces: one for one, two for one, or a move, until no step
helps. A step is taken only if the sum of squared fills grows, so fuller bins fill up and emptier
ones run empty and vanish. Groups are independent, so their number grows with the data.

Tokens are looked up by chunk of text between ASCII white space, where the tokenizer's file says
that no token spans white space; then the ids of a text are those of its chunks in order, and a
chunk that was met before in the same worker is not tokenised again. The memory of that table is
bounded. With any other file each text goes through the whole tokenizer.

Defined results: a null text is an empty one, which is one piece with the closing id alone;
repeated rows and rows without an id are separate pieces; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import textops
from cairnfield.llm.common import ship, written

CAPACITY = 4096
#: Stands for a null id while pieces are packed.
NO_ID = -(1 << 63)
GROUP_PIECES = 8_192
#: Chunks in either half of a worker's table, pre-tokens beside it, and the longest of them in bytes.
MEMO_CHUNKS, MEMO_PRE_TOKENS, MEMO_BYTES = 400_000, 250_000, 64


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The steps before the model for which chunks may be tokenised on their own.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def is_chunked(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    added = found.get("added_tokens") or []  # those that stand in a text as they are written stay within a chunk
    plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and len(t["content"].split()) == 1 for t in added)
    return plain and all(found.get(k) == v for k, v in CHUNKED.items())


class WholeEncoder:
    """Ids of texts, each by the whole tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
            yield array("I", found.ids).tobytes()


#: That tokenizer's pre-token pattern, on printable lower-case ASCII.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class ChunkEncoder:
    """Ids of texts through a table of chunks; ids are little-endian unsigned 32-bit.

    Printable ASCII is its own byte-level form, so such a chunk is lower-cased and cut here and
    the tokenizer's model sees each of its pre-tokens once; other chunks, and those in which
    an added token (``<|endoftext|>``) is written out, take the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def _pre_token(self, text: str) -> bytes:
        found = self.pre_tokens.get(text)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(text) <= MEMO_BYTES:
                if len(self.pre_tokens) >= MEMO_PRE_TOKENS:
                    self.pre_tokens.clear()
                self.pre_tokens[text] = found
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        others = []
        for chunk in chunks:
            text = chunk.decode()
            if text.isascii() and text.isprintable() and not any(t in text for t in self.added):
                self.memo[chunk] = b"".join(map(self._pre_token, PRE_TOKEN.findall(text.lower())))
            else:
                others.append((chunk, text))
        for some in (others[i : i + 4096] for i in range(0, len(others), 4096)):
            found = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            for (chunk, _), encoding in zip(some, found, strict=True):
                self.memo[chunk] = array("I", encoding.ids).tobytes()

    def _recall(self, chunks: list[bytes]) -> None:
        """Bring chunks into the table: from the older half of it, or by learning them."""
        learn = []
        for chunk in dict.fromkeys(chunks):
            known = self.older.get(chunk)
            if known is None:
                learn.append(chunk)
            else:
                self.memo[chunk] = known
        self._learn(learn)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            memo = self.memo
            chunks = text.split()
            fresh = [c for c in chunks if c not in memo]
            if fresh:
                self._recall(fresh)
            yield b"".join(map(memo.__getitem__, chunks))
            for chunk in fresh:
                if len(chunk) > MEMO_BYTES:
                    memo.pop(chunk, None)
            if len(memo) > MEMO_CHUNKS:  # what isn't asked for again before the next turn goes
                self.older, self.memo = memo, {}


_ENCODERS: dict[str, ChunkEncoder | WholeEncoder] = {}


def encoder(path: str) -> ChunkEncoder | WholeEncoder:
    """The worker's encoder: Python workers are reused, and so is what they have learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = (ChunkEncoder if is_chunked(path) else WholeEncoder)(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, closing: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of each document; ``ids``: with their token ids as binary (unsigned 32-bit, little-endian)."""
    ship(docs.sparkSession)
    end = np.array([closing], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), textops.as_strings(batch.column(1))
            for first, last in textops.chunks(texts):
                out = []
                part = texts.slice(first, last - first).cast(pa.large_binary()).to_pylist()
                for doc, body in zip(keys[first:last], encode(part), strict=True):
                    body += end
                    for number, at in enumerate(range(0, len(body), 4 * capacity)):
                        some = body[at : at + 4 * capacity]
                        out.append((doc, number, at // 4, len(some) // 4, zlib.crc32(some), some))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 5 + ids], names[: 5 + ids])

    rows = docs.select(F.col(key).cast("long"), F.col(f"`{text}`"))
    return rows.mapInArrow(cut, PIECES + (", ids binary" if ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[chosen].append(i)
        else:
            room, chosen = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(chosen)
            open_rooms |= 1 << left
    return bins


class _Donors:
    """For each length, and each sum of two lengths in one bin, the emptiest bin that can give it.

    Pieces of a length are alike, and a bin has few different lengths (90 at 4096 tokens). Entries
    of bins that have left are dropped when they come to the top.
    """

    def __init__(self, capacity: int):
        self.least = np.full((2, capacity + 1), capacity + 1, dtype=np.int64)  # the fill of that bin
        self.heaps: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.stamp: defaultdict[int, int] = defaultdict(int)
        self.empty = capacity + 1

    @staticmethod
    def _offers(pieces: dict[int, list[int]]) -> tuple[list[int], set[int]]:
        sizes = sorted(pieces)
        pairs = {x + y for i, x in enumerate(sizes) for y in sizes[i + 1 :]}
        return sizes, pairs | {2 * x for x in sizes if len(pieces[x]) > 1}

    def add(self, name: int, pieces: dict[int, list[int]], fill: int) -> None:
        for heaps, least, offers in zip(self.heaps, self.least, self._offers(pieces), strict=True):
            for size in offers:
                heappush(heaps[size], (fill, name, self.stamp[name]))
                least[size] = min(least[size], fill)

    def remove(self, name: int, pieces: dict[int, list[int]]) -> None:
        self.stamp[name] += 1
        for heaps, least, offers in zip(self.heaps, self.least, self._offers(pieces), strict=True):
            for size in offers:
                heap = heaps[size]
                while heap and heap[0][2] != self.stamp[heap[0][1]]:
                    heappop(heap)
                least[size] = heap[0][0] if heap else self.empty

    def best(self, pieces: dict[int, list[int]], fill: int, room: int) -> tuple[int, int, int, int] | None:
        """The greatest gain of a bin from one that is no fuller: gain, pieces given, their length, length taken or 0."""
        found, gain = None, 0
        for taken in (0, *pieces):
            for kind in (0, 1) if taken else (0,):
                fits = np.flatnonzero(self.least[kind, taken + gain + 1 : taken + room + 1] <= fill)
                if len(fits):
                    gain += int(fits[-1]) + 1
                    found = gain, kind + 1, taken + gain, taken
        return found


def _split(pieces: dict[int, list[int]], total: int) -> tuple[int, int]:
    """Two lengths of a bin with this sum."""
    return next((x, total - x) for x in sorted(pieces) if total - x in pieces and (2 * x != total or len(pieces[x]) > 1))


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while the sum of squared fills grows; empty bins go.

    Moving a positive number of tokens from a bin to one at least as full always raises that sum.
    All underfull bins take part, and the search ends when none can gain from any other.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    held: dict[int, dict[int, list[int]]] = {}
    donors = _Donors(capacity)
    for name, b in enumerate(bins):
        if b and fill[name] < capacity:
            held[name] = {}
            for i in b:
                held[name].setdefault(int(lengths[i]), []).append(i)
            donors.add(name, held[name], fill[name])

    def give(source: int, target: int, size: int) -> None:
        some = held[source][size]
        held[target].setdefault(size, []).append(some.pop())
        if not some:
            del held[source][size]

    changed = True
    while changed:
        changed = False
        for b in sorted(held, key=lambda k: (-fill[k], k)):
            if not held[b] or fill[b] == capacity:
                continue
            donors.remove(b, held[b])
            while fill[b] < capacity and (step := donors.best(held[b], fill[b], capacity - fill[b])):
                gain, count, given, taken = step
                a = donors.heaps[count - 1][given][0][1]
                donors.remove(a, held[a])
                parts = (given,) if count == 1 else _split(held[a], given)
                if taken:
                    give(b, a, taken)
                for size in parts:
                    give(a, b, size)
                fill[a], fill[b], changed = fill[a] - gain, fill[b] + gain, True
                if held[a]:
                    donors.add(a, held[a], fill[a])
            if fill[b] < capacity:
                donors.add(b, held[b], fill[b])
    out = [b for name, b in enumerate(bins) if b and name not in held]
    return out + [[i for some in pieces.values() for i in some] for pieces in held.values() if pieces]


def pack(parts: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to each row of ``pieces``."""
    ship(parts.sparkSession)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        row = np.array([i for b in bins for i in b], dtype=np.int64)
        sizes = [len(b) for b in bins]
        out = pdf.iloc[row].reset_index(drop=True)
        ends = np.cumsum(out["length"].to_numpy()) - out["length"].to_numpy()
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        out["sequence_id"] = int(pdf["__group"].iloc[0]) * (1 << 32) + np.repeat(np.arange(len(bins)), sizes)
        out["offset"] = ends - ends[first]
        return out.drop(columns="__group")

    names = [f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields]
    parts = parts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))  # pandas has no integer nulls
    # the row's number keeps equal rows, and those without an id, from sharing a group
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = parts.withColumn("__group", F.pmod(place, F.lit(groups)).cast("int"))
    found = dealt.groupBy("__group").applyInPandas(packed, ", ".join([*names, "sequence_id long", "offset long"]))
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def pack_documents(docs: DataFrame, tokenizer: str, closing: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; ``ids``: each row also holds its ids, ready to be written as training files."""
    parts = written(pieces(docs, tokenizer, closing, capacity, key, text, ids), "pieces")
    short = parts.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP_PIECES))
    # full pieces are numbered from the ids that groups can't have
    full = parts.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(groups << 32) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return pack(short, groups, capacity).unionByName(full)
