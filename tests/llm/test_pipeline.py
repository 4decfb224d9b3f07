import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    vocabulary = {"en": [f"en{i}the" for i in range(400)], "fr": [f"éle{i}que" for i in range(400)]}
    rows, labels = [], []

    def add(text, lang, quality):
        rows.append((len(rows), text, lang, f"src{len(rows) % 3}", None if text is None else len(text)))
        labels.append((len(labels), quality, 0))

    for i in range(240):
        lang = "en" if i % 2 else "fr"
        add(" ".join(rng.choice(vocabulary[lang]) for _ in range(120)) + ".", lang, 1)
    for i in range(60):
        add(" ".join(rng.choice(vocabulary["en"]).upper() + "$$$ !!" for _ in range(80)), "en", 0)
    copy = rows[10][1].split()
    copy[5] = "edited"
    add(" ".join(copy), "fr", 1)
    add(rows[11][1], "en", 1)
    passage = " ".join(f"shared{i}the" for i in range(60))
    add(passage + " " + " ".join(rng.choice(vocabulary["en"]) for _ in range(150)), "en", 1)
    add(" ".join(rng.choice(vocabulary["en"]) for _ in range(150)) + " " + passage, "en", 1)
    add(None, None, None)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_in_turn(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean, noise = set(range(240)), set(range(240, 300))
    assert clean <= set(kept["quality"]) and not noise & set(kept["quality"])
    assert clean <= set(kept["language"]) and 304 not in kept["language"]
    assert clean <= set(kept["near_duplicates"]) and not {300, 301} & set(kept["near_duplicates"])
    cut = kept["substrings"]
    assert clean <= set(cut) and {302, 303} <= set(cut)
    assert all(cut[i].text == rows[i][1] and cut[i].n_chars == rows[i][4] for i in clean)
    assert "shared30the" not in cut[302].text and len(cut[302].text.split()) == 150
    assert cut[303].n_chars == len(cut[303].text)


def test_run(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert ids == set(range(240)) | {302, 303}


def test_an_empty_corpus_passes(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_repeated_rows_odd_ids_and_clashing_columns(spark, corpus, tmp_path):
    """Each row twice, rows without an id, an id with two texts, a very long text: the same documents as without."""
    folder, rows = corpus
    words = rows[0][1].split()
    extra = [(None, " ".join(words[::-1]), "en", "x", 1), (None, " ".join(rows[1][1].split()[::-1]), "en", "x", 1), (2, " ".join(rows[3][1].split()[::-1]), "en", "x", 1)]
    rng = random.Random(10)
    extra.append((900, " ".join(f"en{rng.randrange(400)}the" for _ in range(30_000)) + ".", "en", "x", 1))
    base = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.union(base).selectExpr("*", *[f"'mine' AS `{c}`" for c in ("kept", "__id", "__score", "row", "__check", "first", "score", "bucket")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before
    got = sorted((r.doc_id if r.doc_id is not None else -1, len(r.text.split()) > 0, r.kept, r.row) for r in docs.collect())
    assert {g[2:] for g in got} == {("mine", "mine")}
    ids = [g[0] for g in got]
    assert sorted(ids) == sorted([*range(240), 302, 303, -1, -1, 2, 900])
