"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The trie holds, for each context of up to ``ORDER`` bytes, how often each byte followed it in
the training texts; a byte that ends every text is counted too. The probability of a byte starts
at its longest context: with ``n`` occurrences and ``d`` different followers, a follower seen
``c`` times gets ``c / (n + d)`` and the escape to the shorter context ``d / (n + d)``. Bytes
that a longer context has seen are excluded from the counts of the shorter ones. Below order 0
the bytes not yet seen share the rest evenly. The model is pretrained: it isn't updated while
texts are scored.

No context is left out, so the trie grows with the corpus and lives in Spark alone. A byte with
its five before it is one gram, a number of 48 bits with the nearest byte of the context first.
Documents are dealt into buckets, and each bucket brings its different grams once, with their
training counts. Summed over buckets these are the trie: the counts of a shorter context are sums
of those of longer ones. Contexts that agree in their last three bytes form a group, in which each
gram's log probability is worked out. The probabilities go back to the buckets that asked for
them, and so do the training counts of their words; there each text is summed up. On the way keys
lie in packs, one for each bucket and slice of the keys' hashes.

The only thing broadcast is the trie of contexts of two bytes or fewer, of which there are no more
than 65,793 at any input size.

Defined results: a null text is an empty one and has one token, the end; without training rows
every token has a count of zero, and the model is uniform; repeated rows are scored alike;
an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import buckets, textops
from cairnfield.llm.common import ship, written

END, PAD = 0xFF, 0xFE  # no byte of UTF-8
ORDER = 5
#: Words that a task counts before it hands them on, grams that are solved at once and looked up at once.
HELD_WORDS, HELD_GRAMS, LOOKED_UP = 200_000, 1 << 20, 1 << 15
UNKNOWN = float(np.log10(0.1))  # of a word with a count of zero
END_TOKEN = b""  # no word is empty

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _chunks(bodies: list[bytes], most: int = 1 << 20):
    """Ranges of bodies that hold about ``most`` bytes each, or one longer body."""
    first, held = 0, 0
    for i, body in enumerate(bodies):
        if held and held + len(body) > most:
            yield first, i
            first, held = i, 0
        held += len(body)
    if first < len(bodies):
        yield first, len(bodies)


def grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of each text and of its end, one text after the other, and their sizes."""
    size = np.array([len(b) + 1 for b in bodies], dtype=np.int64)
    pad = bytes([PAD]) * ORDER
    line = np.frombuffer(b"".join(part for body in bodies for part in (pad, body, b"\xff")), dtype=np.uint8)
    line = _LOWER[line]  # PAD and END stay
    coded = np.ones(len(line), dtype=bool)
    begin = np.cumsum(size + ORDER) - size - ORDER
    for k in range(ORDER):
        coded[begin + k] = False
    wide = line.astype(np.int64)
    gram = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):  # the k-th byte before
        gram |= wide[ORDER - k : len(wide) - k] << (48 - 8 * k)
    return gram[coded[ORDER:]], size


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys without repeats, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, n
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


class Tally:
    """Different grams of many texts and how often each occurs in those that are learned from."""

    def __init__(self):
        self.keys: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
        self.counts: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
        self.fresh = 0

    def add(self, gram: np.ndarray, learn: bool) -> None:
        key, n = np.unique(gram, return_counts=True)
        self.merge(key, n if learn else np.zeros_like(n))

    def merge(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.fresh += len(key)
        if self.fresh > max(1 << 20, len(self.keys[0])):
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = _merged(self.keys, self.counts)
        self.keys, self.counts, self.fresh = [key], [n], 0
        return key, n


def _low_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Training counts of (two-byte context, byte), at most 2 ** 24 of them, and the bytes of all texts."""

    def tally(batches):
        found, bytes_seen = Tally(), 0
        for batch in batches:
            texts, learn = textops.as_strings(batch.column("text")), batch.column("learn").to_numpy(zero_copy_only=False)
            bodies = texts.cast(pa.large_binary()).to_pylist()
            bytes_seen += sum(map(len, bodies))
            known = [body for body, use in zip(bodies, learn, strict=True) if use]
            for first, last in _chunks(known):
                gram, _ = grams(known[first:last])
                found.add(((gram >> 32) << 8) | (gram & 0xFF), True)
        code, n = found.result()
        code, n = np.append(code, -1), np.append(n, bytes_seen)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], ["code", "n"])

    got = rows.select("text", "learn").mapInArrow(tally, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = got["code"].to_numpy().astype(np.int64), got["n"].to_numpy()
    by = np.argsort(code)
    code, n = code[by], n[by]
    own = code >= 0
    return code[own], n[own], int(n[~own].sum())


def _refine(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of all bytes in contexts with these counts, from those in their shorter contexts.

    ``shorter`` is (rows, 256). The bytes seen here are excluded below: what the shorter
    context gives to the others is scaled up to the whole escape.
    """
    n, seen = counts.sum(1, keepdims=True), counts > 0
    d = seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, shorter)
    left = rest.sum(1, keepdims=True)
    whole = np.maximum(n + d, 1)
    escape = np.where(left > 0, d / whole / np.where(left > 0, left, 1), 0.0)
    own = np.where(left > 0, counts / whole, counts / np.maximum(n, 1))
    return np.where(n > 0, own + rest * escape, shorter)


@dataclass
class Low:
    """Probabilities of all bytes after contexts of one and two bytes (nearest byte first)."""

    slot: np.ndarray  # place of each two-byte context, -1 for those not seen
    p1: np.ndarray
    p2: np.ndarray

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        byte, slot = gram & 0xFF, self.slot[gram >> 32]
        out = self.p1[gram >> 40, byte]
        hit = slot >= 0
        out[hit] = self.p2[slot[hit], byte[hit]]
        return out


def low_orders(code: np.ndarray, n: np.ndarray) -> Low:
    symbols = np.ones(256)
    symbols[PAD] = 0  # is never coded
    p0 = _refine(np.bincount(code & 0xFF, n, minlength=256)[None, :], (symbols / symbols.sum())[None, :])
    one = np.bincount(((code >> 16) << 8) | (code & 0xFF), n, minlength=1 << 16).reshape(256, 256)
    p1 = _refine(one, np.repeat(p0, 256, axis=0))
    contexts = np.unique(code >> 8)
    counts = np.zeros((len(contexts), 256))
    counts[np.searchsorted(contexts, code >> 8), code & 0xFF] = n
    slot = np.full(1 << 16, -1, dtype=np.int32)
    slot[contexts] = np.arange(len(contexts))
    return Low(slot, p1, _refine(counts, p1[contexts >> 8]))


def solve(gram: np.ndarray, n: np.ndarray, low: Low) -> np.ndarray:
    """Log10 probability of each gram, from the training counts of all grams with the same last three bytes of context.

    ``gram`` has no repeats. From order 3 on each context is refined by the next longer one.
    """
    p = low(gram)
    for order in range(3, ORDER + 1):
        key, at, of = np.unique(((gram >> (48 - 8 * order)) << 8) | (gram & 0xFF), return_index=True, return_inverse=True)
        count, shorter = np.bincount(of, n, minlength=len(key)), p[at]
        context = key >> 8
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        size = np.diff(np.append(first, len(key)))
        total, kinds = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(float), first)
        left = 1 - np.add.reduceat(np.where(count > 0, shorter, 0.0), first)
        open_ = left > 1e-12
        whole = np.maximum(np.where(open_, total + kinds, total), 1)
        escape = np.where(total > 0, np.where(open_, kinds / whole / np.where(open_, left, 1), 0.0), 1.0)
        p = np.where(count > 0, count / np.repeat(whole, size), shorter * np.repeat(escape, size))[of]
    return np.log10(p)


class Lookup:
    """Values of 48-bit keys in an open hash table; all keys of an array are asked for at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits)
        place, waiting = self._home(keys), np.arange(len(keys))
        while len(waiting):
            at = place[waiting]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[waiting[free]]  # of several in one place the last one stays
            won = self.keys[at] == keys[waiting]
            self.values[at[won]] = values[waiting[won]]
            waiting = waiting[~won]
            place[waiting] = (place[waiting] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys))
        for at in range(0, len(keys), LOOKED_UP):
            out[at : at + LOOKED_UP] = self._some(keys[at : at + LOOKED_UP])
        return out

    def _some(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        out = self.values.take(place)
        rest = np.flatnonzero(self.keys.take(place) != keys)
        place = place[rest]
        while len(rest):
            place = (place + 1) & self.mask
            found = self.keys[place]
            if (found < 0).any():
                raise KeyError("a gram that its bucket did not ask for")
            hit = found == keys[rest]
            out[rest[hit]] = self.values[place[hit]]
            rest, place = rest[~hit], place[~hit]
        return out


def word_counts(rows: DataFrame) -> DataFrame:
    """Training counts of all words, and of the end as an empty word: word binary, c long."""
    ship(rows.sparkSession)

    def count(batches):
        held: Counter[bytes] = Counter()
        for batch in batches:
            texts = textops.as_strings(batch.column(0))
            held[END_TOKEN] += len(texts)
            for text in texts.cast(pa.large_binary()).to_pylist():
                held.update(text.lower().split())
                if len(held) > HELD_WORDS:
                    yield _word_batch(held)
                    held = Counter()
        yield _word_batch(held)

    parts = rows.select("text").mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


def _word_batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


# Packs of grams have the slices from 0 on, those of words the negative ones.


def _pack_grams(bucket: int, key: np.ndarray, values: np.ndarray, n: int) -> list[tuple]:
    place = (textops.mix64(key.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    return [(k, bucket, textops.squeeze(np.diff(key[of], prepend=0)), textops.squeeze(values[of])) for k, of in buckets.sliced(place, n)]


def _pack_words(bucket: int, words: list[bytes], values: np.ndarray | None, n: int) -> list[tuple]:
    place = np.fromiter((zlib.crc32(w) % n for w in words), dtype=np.int64, count=len(words))
    some = ((k, of, [words[i] for i in of.tolist()]) for k, of in buckets.sliced(place, n))
    return [(-1 - k, bucket, textops.listed(of_slice), None if values is None else textops.squeeze(values[of])) for k, of, of_slice in some]


def _grams_of(pack) -> np.ndarray:
    return np.cumsum(_values_of(pack))


def _values_of(pack, kind=np.int64) -> np.ndarray:
    return np.frombuffer(textops.unsqueeze(pack), dtype=kind)


def _asked(dealt: DataFrame, n: int) -> DataFrame:
    """Packs of each bucket's different grams with their training counts in it, and of its words."""

    def ask(batches):
        now, found, words = None, Tally(), set()
        for bucket, batch in buckets.runs(batches):
            if bucket != now:
                yield from out(now, found, words)
                now, found, words = bucket, Tally(), {END_TOKEN}
            bodies, learn = textops.unsqueezed(batch.column("body")), batch.column("learn").to_pylist()
            for body in bodies:
                words.update(body.lower().split())
            for use in (False, True):
                some = [body for body, flag in zip(bodies, learn, strict=True) if flag == use]
                for first, last in _chunks(some):
                    found.add(grams(some[first:last])[0], use)
        yield from out(now, found, words)

    def out(bucket, found, words):
        if bucket is not None:
            yield buckets.batch_of(_pack_grams(bucket, *found.result(), n))
            yield buckets.batch_of(_pack_words(bucket, list(words), None, n))

    return dealt.sortWithinPartitions("bucket").mapInArrow(ask, buckets.PACKS)


def _counted(asked: DataFrame) -> DataFrame:
    """gram, n (training count) of each gram in the packs."""

    def count(batches):
        now, found = None, Tally()
        for place, batch in buckets.runs(batches, "slice"):
            if place < 0:
                continue
            if place != now:
                yield from out(found)
                now, found = place, Tally()
            for keys, n in zip(batch.column("keys"), batch.column("n"), strict=True):
                found.merge(_grams_of(keys.as_buffer()), _values_of(n.as_buffer()))
        yield from out(found)

    def out(found):
        key, n = found.result()
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["gram", "n"])

    return asked.sortWithinPartitions("slice").mapInArrow(count, "gram long, n long")


def _solved(counted: DataFrame, low, n_slices: int) -> DataFrame:
    """Packs of the log10 probabilities of all grams; low: a broadcast Low."""

    def work(batches):
        key, n = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        held = 0
        for batch in batches:
            key.append(batch.column("gram").to_numpy())
            n.append(batch.column("n").to_numpy())
            held += len(key[-1])
            if held > HELD_GRAMS:
                keys, ns = np.concatenate(key), np.concatenate(n)
                cut = int(np.searchsorted(keys, (keys[-1] >> 24) << 24))  # the last group may go on
                yield from out(keys[:cut], ns[:cut])
                key, n, held = [keys[cut:]], [ns[cut:]], len(keys) - cut
        yield from out(np.concatenate(key), np.concatenate(n))

    def out(key, n):
        if len(key):
            yield buckets.batch_of(_pack_grams(buckets.TABLE, key, solve(key, n, low.value), n_slices))

    groups = counted.repartition(F.shiftright("gram", 24)).sortWithinPartitions("gram")
    return groups.mapInArrow(work, buckets.PACKS)


def _packed_words(words: DataFrame, n: int) -> DataFrame:
    """Packs of log10(count + 0.1) of all words."""

    def pack(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > HELD_WORDS:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def out(held):
        table = pa.Table.from_batches(held)
        return buckets.batch_of(_pack_words(buckets.TABLE, table["word"].to_pylist(), np.log10(table["c"].to_numpy() + 0.1), n))

    return words.select("word", "c").mapInArrow(pack, buckets.PACKS)


def _finder(place: int, table: list[tuple]):
    """Values of grams, or of words, from the table's packs of one slice."""
    if place >= 0:
        of = Lookup(np.concatenate([_grams_of(k) for k, _ in table]), np.concatenate([_values_of(v, float) for _, v in table]))
        return lambda keys: textops.squeeze(of(_grams_of(keys)))
    known = {w: v for k, of in table for w, v in zip(textops.unlisted(k), _values_of(of, float).tolist(), strict=True)}
    return lambda keys: textops.squeeze(np.array([known.get(w, UNKNOWN) for w in textops.unlisted(keys)]))


SCORES = "doc_id long, n_tokens long, n_known long, base double, score double"


def _summed(own: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of one bucket's documents, from the answers to its grams and words."""
    keys = own["doc_id"].combine_chunks()
    found, values, log = [], [], {}
    for place, key, value in zip(answers["slice"].to_pylist(), answers["keys"], answers["n"], strict=True):
        value = _values_of(value.as_buffer(), float)
        if place >= 0:
            found.append(_grams_of(key.as_buffer()))
            values.append(value)
        else:
            log.update(zip(textops.unlisted(key.as_buffer()), value.tolist(), strict=True))
    p = Lookup(np.concatenate(found), np.concatenate(values))
    bodies = textops.unsqueezed(own["body"])
    score, base = np.zeros(len(bodies)), np.zeros(len(bodies))
    n_tokens, n_known = np.zeros(len(bodies), dtype=np.int64), np.zeros(len(bodies), dtype=np.int64)
    for first, last in _chunks(bodies):
        gram, size = grams(bodies[first:last])
        score[first:last] = np.add.reduceat(p(gram), np.cumsum(size) - size)
    for i, body in enumerate(bodies):
        words = body.lower().split()
        words.append(END_TOKEN)
        logs = list(map(log.__getitem__, words))
        n_tokens[i], n_known[i], base[i] = len(words), len(words) - logs.count(UNKNOWN), sum(logs)
    return pa.Table.from_arrays([keys, *map(pa.array, (n_tokens, n_known, base, score))], ["doc_id", "n_tokens", "n_known", "base", "score"])


def score(docs: DataFrame, learn_from: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_known, train_tokens, base_score and score.

    ``learn_from``: a condition on the columns of ``docs``; where it holds, the text is a training text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.expr(learn_from), F.lit(False)).alias("learn"), F.col(f"`{text}`").alias("text"))
    code, n, size = _low_counts(rows)
    low = docs.sparkSession.sparkContext.broadcast(low_orders(code, n))
    words = written(word_counts(rows.where("learn")), "word-counts")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens = int(total["n"])
    whole = tokens + 0.1 * (int(total["v"]) + 1)
    n_buckets = buckets.count(docs, size)
    n_slices = buckets.slices(n_buckets)
    dealt = buckets.dealt(rows, n_buckets)
    asked = _asked(dealt, n_slices).repartition(n_buckets, "slice")
    solved = _solved(_counted(asked), low, n_slices)
    answers = buckets.answered(solved.union(_packed_words(words, n_slices)).union(asked), n_buckets, _finder)
    scored = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_summed, SCORES)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(whole)))).alias("base_score"), "score"
    )
