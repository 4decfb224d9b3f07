import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairnfield.llm import jaccard_join, order_minhash, substring_dedup
from cairnfield.llm.components import connected


def _kept(texts: list[str], window: int) -> list[tuple[int, int, str]]:
    words = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30 if seed else 3)]  # few words: many chance repeats
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts: list[str] = []
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += p[cut:] if rng.random() < 0.5 else p[:cut]
            parts += [rng.choice(vocabulary) for _ in range(rng.randrange(20))]
        texts.append(" ".join(parts))
    texts += texts[:4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _kept(texts, substring_dedup.WINDOW)


def test_substrings_on_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    want = Counter((r.doc_id, *k) for r, k in zip(rows, _kept([r.text or "" for r in rows], 35), strict=True))
    got = substring_dedup.dedup(odd_docs, carry=["lang", "n_words", "doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    whole = {r.doc_id: r.text for r in rows}
    for r in got:
        assert r.row.n_words == 9 and r.row.doc_id == r.doc_id
        if r.n_removed:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        else:
            assert r.kept == whole[r.doc_id]
    assert substring_dedup.dedup(no_docs).count() == 0
    assert substring_dedup.factors(no_docs).count() == 0


def _naive_parse(texts: list[list[str]], window: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Greedy relative Lempel-Ziv parsing, word by word: the longest match in any other document."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for d, own in enumerate(texts):
        i, found = 0, []
        while i < len(own):
            best = (0, 0, 0)
            for e, ref in enumerate(texts):
                for j in range(len(ref) if e != d else 0):
                    n = 0
                    while i + n < len(own) and j + n < len(ref) and own[i + n] == ref[j + n]:
                        n += 1
                    best = max(best, (n, e, j))
            n, e, j = best
            if n >= window:
                found.append((i, n, e, j))
            i += max(n, 1)
        out[d] = found
    return out


def test_factors_match_a_naive_parser(spark):
    rng = random.Random(12)
    texts = [[f"own{d}-{k}" for k in range(rng.randrange(60, 90))] for d in range(8)]
    for d, e in ((0, 1), (2, 3), (4, 5), (6, 7)):  # each passage is in two documents
        for size in (34, 35, rng.randrange(40, 120)):
            passage = [f"p{d}-{size}-{k}" for k in range(size)]
            for t in (texts[d], texts[e]):
                at = rng.choice([k for k in range(len(t)) if t[k].startswith("own")])
                t[at:at] = passage
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(list)
    for r in substring_dedup.factors(docs).collect():
        got[r.doc_id].append((r.start, r.n_words, r.ref_id, r.ref_start))
    want = _naive_parse(texts, substring_dedup.WINDOW)
    assert sum(map(len, want.values())) >= 8
    assert {d: sorted(got[d]) for d in range(8)} == want


def test_factors_of_copies_are_whole_documents(spark):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(d, " ".join(words)) for d in (3, 5, 9)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_words, r.ref_start) for r in substring_dedup.factors(docs).collect()}
    assert got == dict.fromkeys((3, 5, 9), (0, 300, 0))
    assert all(r.ref_id != r.doc_id for r in substring_dedup.factors(docs).collect())


@pytest.mark.parametrize("key", [7, None])
def test_repeated_rows_have_the_factors_of_two(spark, key):
    rng = random.Random(8)
    long, other = ([f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(2))
    found = []
    for copies in (2, 500):
        texts = [" ".join(long)] * copies + [" ".join(other[:50] + long[100:200]), " ".join(other)]
        docs = spark.createDataFrame(list(zip([*[key] * copies, 8, 9], texts, strict=True)), "doc_id long, text string")
        got = substring_dedup.dedup(docs).collect()
        assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(_kept(texts, substring_dedup.WINDOW))
        found.append({(r.doc_id, r.n_factors) for r in got})
        ranges = substring_dedup.duplicate_ranges(substring_dedup._keyed(docs, "doc_id", "text"))
        assert ranges.selectExpr("max(size(ranges)) AS n").first()["n"] <= 400
    assert found[0] == found[1] and len(found[0]) == 3 and max(n for _, n in found[0]) <= 3


def _anchor_rows(plan) -> int:
    """Rows that the joins on an anchor alone have made in an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _anchor_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _anchor_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in kind and "__anchor" in plan.leftKeys().toString() and plan.leftKeys().size() == 1 else 0
    under = plan.children()
    return own + sum(_anchor_rows(under.apply(i)) for i in range(under.size()))


def test_copies_of_a_block_do_not_pass_the_join_with_open_anchors(spark):
    made = []
    for n in (5, 20):
        texts = [" ".join(["very", "common"] * 150 + [f"end{d}-{i}" for i in range(50)]) for d in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        ranges = substring_dedup.duplicate_ranges(substring_dedup._keyed(docs, "doc_id", "text"))
        assert len(ranges.collect()) == n
        made.append(_anchor_rows(ranges._jdf.queryExecution().executedPlan()))
        got = substring_dedup.dedup(docs).collect()
        assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(_kept(texts, substring_dedup.WINDOW))
    # one copy of each different block, however many texts and places have it
    assert 0 < made[0] == made[1] < 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.v: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def _classes(texts: dict[int, str], t: float = 0.8) -> dict[int, tuple[int, int, int]]:
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    by = defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    reps = [min(v) for s, v in by.items() if s]
    parent, degree = {i: i for i in texts}, Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= t * len(sets[a] | sets[b]) - 1e-9:
                degree[a] += 1
                degree[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (rep := min(by[s]) if s else i, degree[rep], root(rep)) for i, s in sets.items()}


def test_jaccard_join_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # so that groups are cut into chunks
    texts: dict[int, str] = {}
    for g in range(6):
        base = [f"{g}-{rng.randrange(1000)}" for _ in range(120)]
        for _ in range([70, 30, 5, 3, 2, 1][g]):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    for t in ("short one", "short one", "short  one", "a b c d", "", None, "lonely words stand here alone tonight"):
        texts[len(texts)] = t
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.rep, r.n_links, r.class_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == _classes(texts)


def test_jaccard_join_on_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(got) == 12
    assert {r.class_id for r in got if r.doc_id in (4, 5)} == {4}
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in got if r.doc_id not in (4, 5, None))
    assert jaccard_join.near_duplicates(no_docs).count() == 0
    assert Counter(r.first for r in got) == {True: 10, False: 2}  # 4 stands for itself and both rows of 5


def test_jaccard_join_of_ids_with_several_texts_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)  # long texts make small chunks
    long = [f"w{i}" for i in range(300)]
    near = [*long[:-1], "end"]
    rows = [(1, " ".join(long)), (1, "quite another text that has the same id"), (2, " ".join(near)), (None, " ".join(near[:-1])), (None, "alone without an id here"), (7, " ".join(long))]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = Counter((r.doc_id, r.rep, r.n_copies, r.n_links, r.class_id, r["first"]) for r in got.collect())
    assert found == Counter([(1, 1, 2, 2, 1, True), (7, 1, 2, 2, 1, False), (2, 2, 1, 2, 1, False), (None, None, 1, 2, 1, False), (1, 1, 1, 0, 1, True), (None, None, 1, 0, None, True)])


def test_texts_that_are_not_compared_do_not_move(spark, monkeypatch):
    near = " ".join(f"n{j}" for j in range(60))
    docs = spark.createDataFrame([(i, f"{near} {i}" if i < 20 else " ".join(f"w{i}-{j}" for j in range(12))) for i in range(400)], "doc_id long, text string")
    seen = []
    blocks = jaccard_join._blocks

    def kept(members, group, payload):
        if payload == ["text"]:
            seen.append(members)
        return blocks(members, group, payload)

    monkeypatch.setattr(jaccard_join, "_blocks", kept)
    whole = {tuple(r) for r in jaccard_join.near_duplicates(docs).collect()}
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    # texts meet the chosen rows in a shuffle at any size, and only those that the bounded map lets through
    assert any("SortMergeJoin [doc_id" in line for line in plan.split("\n"))
    assert any("BroadcastHashJoin [part" in line for line in plan.split("\n"))
    monkeypatch.setattr(jaccard_join, "SLOTS", 4)  # most rows share a bit
    assert {tuple(r) for r in jaccard_join.near_duplicates(docs).collect()} == whole
    chosen = spark.createDataFrame([(3, 5), (7, 9), (None, 1)], "doc_id long, check long")
    rows = spark.createDataFrame([(i, i + 2, f"t{i}") for i in range(3000)] + [(3, 5, "t3"), (3, 6, "x")], "doc_id long, check long, text string")
    monkeypatch.setattr(jaccard_join, "SLOTS", 1 << 24)
    got = jaccard_join._texts_of(rows, chosen)
    assert sorted((r.doc_id, r.check, r.text) for r in got.collect()) == [(3, 5, "t3"), (3, 5, "t3"), (7, 9, "t7")]
    assert len(whole) == 400 and sum(r[4] == 19 for r in whole) == 20  # n_links


def test_signatures_of_large_sets_differ():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 800_000).astype(np.uint64)
    sig = jaccard_join.signatures(hashes, np.array([0, 400_000, 800_000]))
    assert (sig[0] == sig[1]).mean() < 0.02


def test_bayes_bounds_keep_true_pairs():
    steps = jaccard_join.least_matches()
    rng = np.random.default_rng(1)
    draws = rng.random((20000, jaccard_join.SIZE)) < 0.8
    assert all((draws[:, :k].sum(1) >= least).all() for k, least in steps)
    low = rng.random((20000, jaccard_join.SIZE)) < 0.4
    assert not any((low[:, :k].sum(1) >= least).any() for k, least in steps[2:])


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 63, 40).astype(np.uint64)])
    sig = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, 400, 800]))
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.1


def test_order_minhash_sees_edits_and_order():
    rng = random.Random(6)
    words = [f"{rng.randrange(10**6)}" for _ in range(400)]
    own = order_minhash.fingerprint(" ".join(words))
    edit = list(words)
    edit[100] = "changed"
    near = order_minhash.likeness(own, order_minhash.fingerprint(" ".join(edit)))
    moved = order_minhash.likeness(own, order_minhash.fingerprint(" ".join(words[200:] + words[:200])))
    other = order_minhash.likeness(own, order_minhash.fingerprint(" ".join(f"{rng.randrange(10**6)}" for _ in range(400))))
    assert near > 0.8 > moved > other
    assert order_minhash.likeness(order_minhash.fingerprint(""), order_minhash.fingerprint("")) == 1


def test_order_minhash_takes_all_numbered_kmers_of_repetitive_texts():
    rng = random.Random(7)
    one, two = (" ".join(f"{rng.randrange(10**6)}" for _ in range(12)) + ". " for _ in range(2))
    long = one * 600
    own = order_minhash.fingerprint(long)
    assert len(set(own.tolist())) > order_minhash.SKETCHES // 2
    assert order_minhash.likeness(own, order_minhash.fingerprint(order_minhash.edited(long, two * 600))) < 0.9
    assert order_minhash.likeness(own, order_minhash.fingerprint(two * 600)) < 0.1
    assert order_minhash.likeness(own, order_minhash.fingerprint(one * 599 + two)) > 0.8


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _order_minhash(data: bytes, k: int = 8, size: int = 2, sketches: int = 32) -> list[int]:
    """The definition in plain integers, with nothing of the module."""
    if data and len(data) < k:
        data = data.ljust(k, b"\xff")
    kmers = [_splitmix(int.from_bytes(data[i : i + k], "little")) for i in range(len(data) - k + 1)]
    seeds = [_splitmix(s) | 1 for s in range(1, sketches + 1)]
    seen, elements, out = Counter(), [], []
    for h in kmers:
        e = _splitmix((h + seen[h] * seeds[0]) % 2**64)
        elements.append(e ^ e >> 31)
        seen[h] += 1
    for seed in seeds:
        chosen = sorted(i for _, i in sorted((e * seed % 2**64, i) for i, e in enumerate(elements))[:size])
        total = 0
        for i in chosen:
            total = _splitmix((total * seeds[1] + kmers[i]) % 2**64)
        out.append(total >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "ab" * 9000, "passage of words, " * 700, "x" * 5000 + "tail and more", "éñ🙂" * 50])
def test_order_minhash_matches_brute_force(text):
    assert order_minhash.fingerprint(text).tolist() == _order_minhash(text.encode())


def test_neighbours_without_ids(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RUN_ROWS", 3)
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(10)], "doc_id long, text string")
    got = order_minhash.neighbours(docs).collect()
    assert len(got) == 10 and all(r.doc_id is None for r in got)
    both = order_minhash.neighbours(docs.union(spark.createDataFrame([(5, "the last one")], docs.schema)))
    assert Counter(r.doc_id for r in both.collect()) == {None: 10, 5: 1}


def test_neighbours(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(order_minhash, "RUN_ROWS", 7)
    rng = random.Random(8)
    texts = {i * 3: "".join(rng.choice("abcé ñ🙂") for _ in range(rng.randrange(0, 80))) for i in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in order_minhash.neighbours(docs).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        changed = texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[j][: len(texts[i]) // 4]
        a, b, e = (order_minhash.fingerprint(t) for t in (texts[i], texts[j], changed))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (order_minhash.as_hex(a), order_minhash.as_hex(e))
        assert (r.near_edited, r.near_next) == ((a == e).mean(), (a == b).mean())
    assert order_minhash.neighbours(odd_docs).count() == 12
    assert order_minhash.neighbours(no_docs).count() == 0
    assert order_minhash.neighbours(docs.limit(1)).first().near_next == 1


def test_fingerprint_column(spark, odd_docs):
    got = order_minhash.fingerprints(odd_docs).collect()
    assert len({r.fingerprint for r in got if not r.text}) == 1 and len(got) == 12
