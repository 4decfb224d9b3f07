"""One query for each text operator, with its production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import byte_bpe, hard_negatives, jaccard_join, language_id, order_minhash, packing, ppm, quality_gam, quality_rules, sharding, spelling, substring_dedup, url_filter
from cairnfield.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]

#: The host rules of op2.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


#: One fold in so many is held out; a document with at least this score is kept.
FOLDS, LM_FOLDS, KEEP_FROM = 5, 10, 0.3
#: Shards of op12, and with one more.
SHARDS, GROWN = 40, 41


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.filter_urls(pages, rules=URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rep", "n_copies", "n_links", "class_id")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), LM_FOLDS) == 0
    scored = ppm.score(docs, f"crc32(cast(cast(doc_id AS string) AS binary)) % {LM_FOLDS} <> 0")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_gam.train(docs, labels.where(crc_mod(F.col("doc_id"), FOLDS) != 0))
    rows = docs.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == 0)
    scored = quality_gam.score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == 0)
    model = language_id.train(rows.where(~F.col("held_out")))
    return language_id.identify(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shards(docs, sharding.planned(SHARDS), sharding.planned(GROWN))


def op13_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_quality_rules": op3_quality_rules,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_ppm": op6_ppm,
        "op7_quality_gam": op7_quality_gam,
        "op8_language_id": op8_language_id,
        "op9_packing": op9_packing,
        "op10_order_minhash": op10_order_minhash,
        "op11_dual_tree": op11_dual_tree,
        "op12_hash_tree": op12_hash_tree,
        "op13_errata_trie": op13_errata_trie,
    }


def oracle_sql() -> dict[str, str]:
    from cairnfield.llm import oracles

    return oracles.sql()
