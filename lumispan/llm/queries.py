"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, langid, licenses, minhash, mixing, oracles, pieces, quality, sharding, urlfilter
from .common import stored, table

# The rules of the url query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = stored(quality.features(docs).drop("text"))
    cutoffs = quality.fit(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, cutoffs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted once
    sized = stored(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    planned = mixing.repetitions(sized, size_col="words")
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), model_path(), keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_url_filter, op4_quality_rules, op5_sharding, op6_chat_formatting, op7_mixing, op8_license_scan, op9_sentencepiece, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    """Fitted, hashed or tokenizer results have no SQL; tests hold them against brute force."""
    return {
        "op2_exact_dedup": oracles.EXACT_DEDUP,
        "op3_url_filter": oracles.url_filter(URL_RULES),
        "op6_chat_formatting": oracles.CHAT,
        "op7_mixing": oracles.MIXING,
        "op8_license_scan": oracles.license_scan(),
        "op10_minhash": oracles.MINHASH,
    }
