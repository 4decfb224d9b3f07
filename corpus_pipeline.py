"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's docs. Every stage works on all rows that
its predecessor kept. All but the last return the columns of ``documents``.

Defined results: an empty table passes through every stage; extra columns of ``documents`` are
carried along, whatever their names; a null text is an empty one; of a row that is repeated (the same
id and text) one stays, as of any near copies; rows of one id with different texts are different
documents, and so are rows without an id; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.llm import jaccard_join, language_id, packing, quality_gam, substring_dedup
from cairnfield.llm.common import crc_mod, shared_path, table
from cairnfield.llm.queries import FOLDS, KEEP_FROM

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can express no stage of this pipeline as a whole; it is tested on small sets made by hand.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the additive quality model scores at KEEP_FROM or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_gam.train(docs.select("doc_id", "text"), labels.where(crc_mod(F.col("doc_id"), FOLDS) != 0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")  # no name of a result can clash
    return quality_gam.score(rows, model).where(F.col("score") >= KEEP_FROM).select("__row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts whose language can't be told: those without a letter and ambiguous ones."""
    known = docs.select("doc_id", "text", "lang").where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    model = language_id.train(known)
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    guessed = language_id.identify(judged, model)
    kept = guessed.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: that with the smallest id."""
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    # a row by its id and text: rows without a set are alike in them too
    marks = found.groupBy(F.coalesce("doc_id", F.lit(jaccard_join.NO_ID)).alias("__id"), F.col("check").alias("__check")).agg(F.max("first").alias("__first"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard_join.NO_ID)).alias("__id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__check"),
    )
    once = Window.partitionBy("__id", "__check").orderBy("__id")
    kept = rows.join(marks.where("__first"), ["__id", "__check"]).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return kept.select("__row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of at least 35 words that are found elsewhere; what is left is a document
    of its kept words. A document of which nothing is left goes."""
    cut = substring_dedup.dedup(docs, carry=[c for c in docs.columns if c != "text"])
    rows = cut.where("n_removed = 0 OR kept <> ''")
    size = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept")).cast("long")
    new = {"text": F.col("kept"), "n_chars": size}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most 4096."""
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
