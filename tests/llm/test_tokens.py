import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_heap_agrees_with_the_library(library):
    ranks = byte_bpe.read_ranks(RANKS)
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdefgh \xc3\xa9") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    for word in [*words, b"a" * 3000, "漢字".encode() * 200]:
        assert byte_bpe.fold_long(word, ranks) == library._encode_single_piece(word)


def test_native_fold_and_decoding(spark, library):
    ranks = byte_bpe.read_ranks(RANKS)
    rng = random.Random(2)
    words = [b"", b"a", b" the", b" unfoldable", "é漢🙂".encode(), b"\xff\xfe", b" antidisestablishment", b"ab" * 60]
    words += [bytes(rng.choice(b"abcdefgh \xc3\xa9\xff") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    df = byte_bpe.fold_words(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"), ranks)
    for r in df.withColumn("back", byte_bpe.decode(df["ids"], ranks)).collect():
        word = bytes(r.word)
        assert r.ids == (library._encode_single_piece(word) if word else []) and bytes(r.back) == word
    short = byte_bpe.fold_words(df.select("word"), ranks, most=10).collect()
    assert all((r.ids is None) == (len(r.word) > 10 and bytes(r.word) not in ranks) for r in short)


def test_chunks_split_like_whole_texts():
    import regex

    whole, splitter = regex.compile(public_tokenizers.PATTERN).findall, byte_bpe.Splitter(public_tokenizers.PATTERN)
    assert public_tokenizers.PATTERN == byte_bpe.SPACED
    rng = random.Random(4)
    alphabet = ["a", "B", "'s", "'", "9", "!", " ", " ", " ", "\n", "\t", "\x1c", "\x85", "\u2028", "é", "漢", "🙂"]
    cut = 0
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14)))
        first, rest = splitter.chunks(text)
        cut += len(rest)
        assert [*splitter.words(first), *(w for c in rest for w in splitter.words(" " + c))] == whole(text), repr(text)
    assert cut > 1000
    assert byte_bpe.Splitter(r"\S+|\s+").chunks("a b") == ("a b", [])


def test_texts_round_trip(spark, odd_docs, no_docs, library):
    docs = odd_docs.withColumns({"copy": odd_docs["text"], "bucket": odd_docs["doc_id"], "ids": odd_docs["lang"]})
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ids=True).collect()
    assert len(got) == 12 and got[0].asDict().keys() == {*docs.columns, "decoded", "n_tokens", "ids_sha256", "decoded_sha256"} - {"text"}
    for r in got:
        text = r.copy or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode() and r.bucket == r.doc_id
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    in_tasks = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    names = ["doc_id", "copy", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {*in_tasks.columns} == {*docs.columns, *names} - {"text", "ids"}
    assert Counter(in_tasks.select(names).collect()) == Counter(tuple(r[c] for c in names) for r in got)
    assert byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    special = odd_docs.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("end <|endoftext|> start a<|startoftext|><|EndOfText|>b")})
    assert tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids == [49407]
    odd_docs = odd_docs.union(special)
    rows = packing.pack_documents(odd_docs, WORDS, ids=True).collect()
    want = []
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            want.append((r.doc_id, p, at, len(part) // 4, zlib.crc32(part)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_chunks_need_no_context(tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    encode = packing.ChunkEncoder(WORDS)
    rng = random.Random(3)
    alphabet = ["a", "B", "'s", "don't", "9", "!", "##", " ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "é", "é", "Σ", "İ", "漢", "🙂", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 4, 5, 5, 3, 7, 2, 8, 1, 9])
    start = [[i] for i in range(12)]
    got = packing.local_search([list(b) for b in start], lengths, 10)
    assert sorted(i for b in got for i in b) == list(range(12))
    assert all(lengths[b].sum() <= 10 for b in got) and len(got) == 6
    rng = np.random.default_rng(1)
    many = rng.integers(1000, 2500, 800)
    fit = packing.best_fit(many, 4096)
    assert len(packing.local_search([list(b) for b in fit], many, 4096)) <= len(fit)


@pytest.mark.parametrize("least, most, n, capacity", [(1400, 2700, 600, 4096), (900, 1500, 400, 4096), (1, 40, 300, 50), (2, 300, 200, 301)])
def test_local_search_leaves_no_step_between_any_bins(least, most, n, capacity):
    rng = np.random.default_rng(4)
    lengths = rng.integers(least, most, n)
    fit = packing.best_fit(lengths, capacity)
    got = packing.local_search([list(b) for b in fit], lengths, capacity)
    assert sorted(i for b in got for i in b) == list(range(n)) and len(got) <= len(fit)
    fill = [int(lengths[b].sum()) for b in got]
    assert max(fill) <= capacity
    values = [sorted({int(lengths[i]) for i in b}) for b in got]
    pairs = [{int(lengths[i] + lengths[j]) for k, i in enumerate(b) for j in b[k + 1 :]} for b in got]
    for a in range(len(got)):
        for b in range(len(got)):
            if a == b or fill[a] > fill[b] or fill[b] == capacity:
                continue
            room = capacity - fill[b]
            assert not any(x <= room for x in values[a])
            assert not any(0 < x - y <= room for x in [*values[a], *pairs[a]] for y in values[b])


def test_local_search_pairs_of_a_bin_of_many_pieces():
    lengths = np.array([2] * 1000 + [3, 3, 4089])  # only two of 2 for one of 3 fill the second bin
    got = packing.local_search([list(range(1000)), [1000, 1001, 1002]], lengths, 4096)
    assert sorted(int(lengths[b].sum()) for b in got) == [1999, 4096]


def test_full_pieces_are_passed_by(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(packing, "pack", lambda parts, groups, capacity, own=packing.pack: sizes.append((parts.count(), groups)) or own(parts, groups, capacity))
    monkeypatch.setattr(packing, "GROUP_PIECES", 4)
    docs = spark.createDataFrame([(i, "word " * 300) for i in range(10)], "doc_id long, text string")
    rows = packing.pack_documents(docs, WORDS, capacity=16).collect()
    short = [r for r in rows if r.length < 16]
    assert sizes == [(len(short), -(-len(short) // 4))] and len(rows) > 100
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 16 and all(fills[r.sequence_id] == 16 and r.offset == 0 for r in rows if r.length == 16)


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    docs = spark.createDataFrame([(None, "the same words") for _ in range(400)], "doc_id long, text string")
    rows = packing.pack_documents(docs, WORDS).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 400 and len(groups) > 10 and max(groups.values()) < 60


def test_other_tokenizers_take_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(other, file)
    assert packing.is_chunked(WORDS) and not packing.is_chunked(path)
    text = "Upper and lower"
    assert np.frombuffer(next(iter(packing.encoder(path)([text.encode()]))), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_comes_near_the_lower_bound():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(6, 1, 8000).astype(int) + 1, 4095)
    got = packing.local_search(packing.best_fit(lengths, 4096), lengths, 4096)
    assert len(got) <= -(-int(lengths.sum()) // 4096) + 1


def test_best_fit_fills_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1500, 5000)
    bins = packing.best_fit(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert max(lengths[b].sum() for b in bins) <= 4096
    assert len(bins) <= -(-lengths.sum() // 4096) + 2
