"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One linear classifier for each bit, on hashed byte
trigrams and single bytes, predicts it; the text gets the language whose codeword has the
smallest loss, summed over the bits with each bit's weight. A text whose best two codewords
are nearly as close is flagged as ambiguous.

Up to five languages the code is exhaustive (every way of splitting them in two), beyond that
a random code of fixed seed. The classifiers are fitted on about ``SAMPLE_ROWS`` rows, spread
evenly over the languages by the hash of their ids; every row is classified.

Defined results: a null text or one without a letter is ``und`` with score 0; without training
rows each text is ``und``; of codewords that are equally close the language first in the alphabet is
chosen, and the text is flagged; rows with a null language are not learned from; repeated rows get
the same answer. Columns of the input stay, except those with the name of a result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm import textops
from cairnfield.llm.common import ship

#: At most so many rows are learned from, or LEAST_ROWS of each language where those are more.
SAMPLE_ROWS, LEAST_ROWS = 6_000, 4
#: Parts of a language's rows that meet its count apart from one another.
SALTS = 64
#: Classes up to which random codes are compared, as that takes a table of all pairs of classes.
MOST_COMPARED = 2_000
TRIGRAMS = 2048
WIDTH = TRIGRAMS + 256
UNDETERMINED = "und"
#: Two codewords whose losses differ by less are ambiguous.
MARGIN = 0.25
STEPS, STEP_SIZE, DECAY = 300, 1.0, 1e-4


def _folded() -> np.ndarray:
    """Bytes with ASCII letters in lower case and everything else below 128 as a space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 0x20
    fold[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return fold


FOLDED = _folded()


def vectors(texts: pa.Array):
    """For each chunk of texts: its first row, and a unit vector for each text."""
    for first, last in textops.chunks(texts, 1 << 19):
        data, at = textops.raw(texts.slice(first, last - first))
        n = last - first
        low = FOLDED[data]
        if len(data) > 1:  # Latin-1 capitals in UTF-8
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[1:][capital] += 0x20
        owner = np.repeat(np.arange(n), np.diff(at))
        count = np.bincount(owner * 256 + low, minlength=n * 256).reshape(n, 256).astype(np.float32)
        count[:, 0x20] = 0
        wide = low.astype(np.uint32)
        key = np.zeros(0, dtype=np.uint32)
        same = np.zeros(0, dtype=bool)
        if len(low) > 2:
            key = ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761) >> np.uint32(32 - 11)
            same = (owner[:-2] == owner[2:]) & ((low[:-2] != 0x20) | (low[1:-1] != 0x20))
        grams = np.bincount(owner[: len(key)][same] * TRIGRAMS + key[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        x = np.sqrt(np.concatenate([grams.astype(np.float32), count], axis=1))
        yield first, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: exhaustive up to five classes, else the best of 50 random codes, or the first of very many classes."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        code = [[1] * bits] + [[1 if (b >> (n - 1 - r)) & 1 else -1 for b in range(bits)] for r in range(1, n)]
        return np.array(code, dtype=float)
    bits, best, most = 8 * int(np.ceil(np.log2(n))), None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        if n > MOST_COMPARED:
            return code
        same = (bits + code @ code.T) / 2
        apart = int(bits - (same - bits * np.eye(n)).max())
        if apart > most and not (np.abs(code.sum(0)) == n).any():
            best, most = code, apart
    return best if best is not None else code


@dataclass
class Decoder:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray = field(default_factory=lambda: np.ones((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 0), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of belief, and by how much the next one is farther."""
        out = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -out) * self.trust) @ (self.code > 0).T + (np.logaddexp(0, out) * self.trust) @ (self.code < 0).T
        best = loss.argmin(1)
        least = loss[np.arange(len(x)), best]
        belief = 1 / np.exp(least[:, None] - loss).sum(1)
        apart = np.partition(loss, 1, axis=1)[:, 1] - least if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, belief, apart


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Decoder:
    """One logistic classifier for each bit of the code (gradient steps with momentum)."""
    code = codewords(len(languages))
    target = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        slope = (-target / (1 + np.exp(np.clip((x @ w + b) * target, -30, 30)))).astype(np.float32) / max(len(x), 1)
        vw = 0.9 * vw - STEP_SIZE * 10 * (x.T @ slope + DECAY / 10 * w)
        vb = 0.9 * vb - STEP_SIZE * slope.sum(0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * target > 0).mean(0) if len(x) else np.ones(code.shape[1])
    trust = np.maximum(2 * right - 1, 0.01)
    return Decoder(languages, code, w, b, trust / trust.mean() if len(trust) else trust)


def _in_order(got: pa.Table) -> tuple[np.ndarray, list[str]]:
    """The vectors and languages of the sample by hash and language; a batch at once is copied into their place."""
    order = pc.sort_indices(got, sort_keys=[("h", "ascending"), ("lang", "ascending")]).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    x, first = np.empty((len(order), WIDTH), dtype=np.float32), 0
    for batch in got.select(["x"]).to_batches(max_chunksize=500):
        x[place[first : first + len(batch)]] = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float16).reshape(-1, WIDTH)
        first += len(batch)
    return x, got["lang"].take(pa.array(order)).to_pylist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Decoder:
    """Learn from rows with a language and a letter, about as many of each language; every language is learned.

    Rows that agree in id, text and language count once. Those of the smallest hashes are taken, so
    the sample depends on the rows alone; texts are taken whole, however long.
    """
    ship(docs.sparkSession)
    body = F.col(f"`{text}`")
    known = docs.where(F.col(f"`{lang}`").isNotNull()).where(body.rlike(r"\p{L}"))
    known = known.select(F.xxhash64(F.col(f"`{key}`"), body).alias("h"), body.alias("text"), F.col(f"`{lang}`").alias("lang"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    languages = counts.count()
    if not languages:
        return Decoder()
    each = max(LEAST_ROWS, -(-rows // languages))
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    salt = F.pmod("h", F.lit(SALTS)).alias("salt")  # a frequent language meets its count in many tasks
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    once = known.select("lang", "h", salt).distinct()  # repeated rows go before they are dealt
    drawn = once.join(salted, ["lang", "salt"]).where(draw < 2.0 * each / F.col("n")).select("lang", "h")
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).drop("k")  # within the bound above
    few = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def describe(batches):
        for batch in batches:
            for first, x in vectors(textops.as_strings(batch.column("text"))):
                part = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["h", "lang", "x"])

    x, seen = _in_order(few.mapInArrow(describe, "h long, lang string, x binary").toArrow())
    pa.default_memory_pool().release_unused()  # else the driver keeps the sample's memory in each training
    languages = sorted(set(seen))
    place = {v: i for i, v in enumerate(languages)}
    return fit(x, np.array([place[v] for v in seen]), languages)


def identify(docs: DataFrame, model: Decoder, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add lang_pred, score and ambiguous to each row."""
    ship(docs.sparkSession)

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def guess(texts: pa.Array) -> pa.Array:
        strings = textops.as_strings(texts)
        n = len(strings)
        best, belief, apart = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
        if model.languages:
            for first, x in vectors(strings):
                part = slice(first, first + len(x))
                best[part], belief[part], apart[part] = model.decode(x)
        names = pa.array(model.languages or [UNDETERMINED]).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(np.clip(belief, 0, 1)), pa.array(apart < margin)], ["lang_pred", "score", "ambiguous"])

    body = F.col(f"`{text}`")
    letters = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    rows = docs.withColumn("__guess", guess(body))
    return rows.withColumns(
        {
            "lang_pred": F.when(letters, F.col("__guess.lang_pred")).otherwise(UNDETERMINED),
            "score": F.when(letters, F.col("__guess.score")).otherwise(0.0),
            "ambiguous": F.when(letters, F.col("__guess.ambiguous")).otherwise(True),
        }
    ).drop("__guess")
