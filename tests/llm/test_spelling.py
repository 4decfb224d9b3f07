import random
import re
import zlib
from collections import Counter

import pytest

from cairnfield.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], commoner: int = 5) -> dict[str, tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= commoner * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def got(df) -> dict[str, tuple]:
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(("letters", "longest"), [("ab", 7), ("abc", 5), ("abcdefgh", 3), ("aé", 6)])
def test_near_words_match_brute_force(spark, letters, longest):
    rng = random.Random(longest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest + 1))): rng.choice([1, 2, 5, 10, 11, 55, 300, 1500]) for _ in range(150)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(table)) == brute(words)


def counted(rows) -> dict[str, int]:
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_words_of_texts(spark, odd_docs, no_docs):
    rng = random.Random(8)
    base = ["receive", "recieve", "received", "Séparer", "SÉPARER", "separer", "straße", "ÿlands", "colour", "color", "colours", "sixsix", "four4five"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(40)) + rng.choice([".", "\n", "_", "×÷"])) for i in range(300)]
    rows += [(None, "colour " * 3000), (7, None), (8, ""), (9, "  "), (10, "x" * 50_000), *[(11, "repeated repeeted")] * 9]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = counted(rows)
    assert len(want) > 12 and {r.word: r.n for r in spelling.words(table).collect()} == want
    assert got(spelling.group(table)) == brute(want)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(spelling.group(odd_docs.withColumnRenamed("lang", "word").withColumnRenamed("source", "n"))) == brute(counted(odd))
    assert spelling.group(no_docs).count() == 0


def test_chains_lead_to_the_last_form(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15_625}
    found = got(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[1] for v in found.values()} == {"abbbbb"}
    assert found == brute(words)


def test_light_edges_are_few(spark):
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdef") for _ in range(8)) for _ in range(2000)})
    light, _ = spelling.light_edges(spark.createDataFrame([(w, 1) for w in words], "word string, n long"))
    most = max(r["count"] for r in light.groupBy("word").count().collect())
    assert most <= len(words).bit_length()
