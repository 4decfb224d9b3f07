import math
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import language_id, ppm, quality_gam


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (3, 5) in [p[:2] for p in model.pairs]


def test_quality_held_out_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice(["JUNK!!", "MORE!!", "a$$$", "b%%%"]) for _ in range(40)) for _ in range(150)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(9999, None)], "doc_id long, quality int")
    model = quality_gam.train(docs, labels)
    held = {i: q for i, _, q in rows if not i % 5}
    got = {r.doc_id: r.score for r in quality_gam.score(docs, model).collect() if r.doc_id in held}
    assert all((got[i] >= 0.3) == bool(q) for i, q in held.items())
    odd = quality_gam.score(odd_docs, model).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 and r.n_words == 9 for r in odd)
    assert quality_gam.score(no_docs, model).count() == 0
    twice = quality_gam.train(docs.union(docs), labels.union(labels))
    assert {r.doc_id: r.score for r in quality_gam.score(docs, twice).collect()} == {r.doc_id: r.score for r in quality_gam.score(docs, model).collect()}
    nothing = quality_gam.train(docs, labels.limit(0))
    assert {r.score for r in quality_gam.score(docs.limit(3), nothing).collect()} == {0.5}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 17):
        code = language_id.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2)


def test_language_held_out_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(2)
    words = {"aa": ["ba", "bab", "abba"], "bb": ["ti", "tit", "itti"], "cc": ["ro", "orro", "ror"], "dd": ["élu", "ülé", "léü"]}
    rows = [(i, " ".join(rng.choice(words[la]) for _ in range(30)), la) for i in range(400) for la in [list(words)[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 300"))
    got = language_id.identify(docs.where("doc_id >= 300"), model).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.identify(odd_docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3, 7))
    assert odd[8].lang_pred in words
    assert language_id.identify(no_docs, model).count() == 0
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), none).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), one).collect()} == {"aa"}


def _sizes(monkeypatch, module) -> list[tuple[int, int]]:
    """Rows and different rows of each call of the module's ``fit``."""
    seen = []
    own = module.fit
    monkeypatch.setattr(module, "fit", lambda x, *more: seen.append((len(x), len(np.unique(x, axis=0)))) or own(x, *more))
    return seen


def test_language_samples_are_bounded_whatever_the_ids(spark, monkeypatch):
    seen = _sizes(monkeypatch, language_id)
    monkeypatch.setattr(language_id, "STEPS", 2)
    texts = [(7, f"{'ab' * (i % 50)} {chr(97 + i % 26)}{chr(97 + i // 26)} of one id" if i < 600 else "the same row again", ["aa", "bb"][i % 2]) for i in range(10_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    language_id.train(docs, rows=200)
    assert seen[0][0] == 200 and seen[0][1] >= 190
    language_id.train(docs.where("text = 'the same row again'"), rows=200)
    assert seen[1][0] == 2  # of each language once


def test_every_language_is_learned(spark, monkeypatch):
    seen = _sizes(monkeypatch, language_id)
    monkeypatch.setattr(language_id, "STEPS", 2)
    rows = [(i, f"word{i} of number {i}", f"l{i % 1500:04d}") for i in range(4 * 1500)] + [(-1, None, "none"), (-2, "12", "digits")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, rows=100)
    assert model.languages == [f"l{i:04d}" for i in range(1500)] and seen[0][0] == 6000
    assert {r.lang_pred for r in language_id.identify(docs.limit(20), model).collect()} <= set(model.languages) | {"und"}


def test_the_sample_of_languages_is_put_in_order_a_batch_at_once():
    rng = np.random.default_rng(5)
    n = 4000
    rows = rng.random((n, language_id.WIDTH)).astype(np.float16)
    h, lang = rng.integers(0, 50, n), rng.permutation(n)
    got = pa.table({"h": h, "lang": [f"{v:05d}" for v in lang], "x": pa.array([r.tobytes() for r in rows], pa.binary())})
    tracemalloc.start()
    x, seen = language_id._in_order(got)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.lexsort([lang, h])
    assert (x == rows[order].astype(np.float32)).all() and seen == [f"{lang[i]:05d}" for i in order]
    assert most < 1.3 * x.nbytes  # joined as a whole it is 1.5 times


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_training_leaves_no_sample_in_the_driver(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(20)), "xy"[i % 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def resident() -> float:
        lines = Path("/proc/self/smaps_rollup").read_text().splitlines()
        return sum(int(line.split()[1]) for line in lines if line.startswith("Pss_Anon")) / 1024

    language_id.train(docs)
    left = resident()
    pa.default_memory_pool().release_unused()
    assert left - resident() < 20  # MB; the sample is 28


def test_quality_labels_that_repeat_do_not_fill_the_bound(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality")
    repeated = labels.where("doc_id = 5").crossJoin(spark.range(10_000).select(F.lit(1).alias("k"))).drop("k")
    both = spark.createDataFrame([(8, 1), (8, 0)], "doc_id long, quality int")
    x, y = quality_gam.labelled_features(docs, labels.union(repeated).union(both), "quality", rows=100)
    assert len(x) == len(y) == 100
    x, y = quality_gam.labelled_features(docs.where("doc_id = 8"), both.union(both), "quality", rows=100)
    assert sorted(y) == [0.0, 1.0] and (x[0] == x[1]).all()


def _brute(learned: list[bytes], text: bytes, order: int = 5) -> float:
    """PPM by its definition, with dictionaries and nothing of the module: 0xFE pads, 0xFF ends."""
    counts: dict[bytes, Counter] = {}
    for t in learned:
        line = b"\xfe" * order + t.lower() + b"\xff"
        for i in range(order, len(line)):
            for k in range(order + 1):
                counts.setdefault(line[i - k : i], Counter())[line[i]] += 1

    def dist(context: bytes | None) -> dict[int, float]:
        if context is None:
            return {b: 1 / 255 for b in range(256) if b != 0xFE}
        shorter = dist(context[1:] if context else None)
        own = counts.get(context)
        if own is None:
            return shorter
        n, d = own.total(), len(own)
        rest = sum(p for b, p in shorter.items() if b not in own)
        return {b: own[b] / (n + d) if b in own else p / rest * d / (n + d) for b, p in shorter.items()}

    line = b"\xfe" * order + text.lower() + b"\xff"
    return sum(math.log10(dist(line[i - order : i])[line[i]]) for i in range(order, len(line)))


LEARN = "crc32(cast(cast(doc_id AS string) AS binary)) % 10 <> 0"


def test_ppm_matches_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB céЖ") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs, LEARN).collect()}
    known = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in known for w in [*t.lower().split(), b""])
    n, v = sum(words.values()), len(words)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        tokens = [*t.encode().lower().split(), b""]
        assert got[i].n_tokens == len(tokens) and got[i].n_known == sum(words[w] > 0 for w in tokens) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert got[i].score == pytest.approx(_brute(known, t.encode()), rel=1e-9)


def test_ppm_odd_rows(spark, odd_docs, no_docs):
    odd = ppm.score(odd_docs, "doc_id < 9").collect()
    assert len(odd) == 12 and all(r.score < 0 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 5)}) == 1
    assert {r.n_tokens for r in odd if r.doc_id in (1, 2, 3)} == {1}
    assert ppm.score(no_docs, LEARN).count() == 0
    fresh = ppm.score(odd_docs.limit(2), "false").collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in fresh)
    assert [r.score for r in fresh] == pytest.approx([-math.log10(255)] * 2)


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    gram, _ = ppm.grams([bytes(rng.choice([97, 98, 99], 50).astype(np.uint8)) for _ in range(20)])
    key, n = np.unique(gram, return_counts=True)
    code, m = np.unique(((gram >> 32) << 8) | (gram & 0xFF), return_counts=True)
    low = ppm.low_orders(code, m)
    context = key[7] >> 8  # all bytes after one context: those that were not seen count 0
    group = key >> 24 == key[7] >> 24
    every = np.union1d(key[group], (context << 8) | np.arange(256))
    counts = np.zeros(len(every), dtype=np.int64)
    counts[np.searchsorted(every, key[group])] = n[group]
    p = 10.0 ** ppm.solve(every, counts, low)[every >> 8 == context]
    assert np.isclose(p[np.arange(256) != ppm.PAD].sum(), 1)


def test_lookup_of_grams():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    found = ppm.Lookup(keys, keys / 2)
    asked = rng.permutation(np.repeat(keys, 2))
    assert (found(asked) == asked / 2).all()
    with pytest.raises(KeyError):
        found(np.array([int(keys[0]) + 1]))
