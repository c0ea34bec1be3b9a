"""A training-corpus pipeline of five stages; each stage works on all rows its predecessor kept.

Every stage takes the columns of documents (COLUMNS) and returns them, the last one digests; other
columns are dropped, whatever their names. Nulls in any column, empty and very long texts, ties and
repeated rows have the results that the operators define; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumispan.llm import exact_dedup, minhash, mixing, pieces, quality
from lumispan.llm.common import discard, stored, table, written
from lumispan.llm.queries import model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages hold operators that SQL cannot express (fitted thresholds, min-hash, a tokenizer); tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified thresholds; each text is measured once.

    A null or empty text fails the base rules, a null language is a stratum, repeated rows are judged alike.
    """
    measured = stored(quality.features(docs.select(*COLUMNS)))
    cutoffs = quality.fit(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, cutoffs).filter("kept").select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each text: the longest original, then the smallest id, null ids last; repeated rows of the owner stay."""
    return exact_dedup.dedup(docs).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; rows without an id or a word are in no group and stay."""
    return minhash.near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, 0 to 2 times; a null source is one, sources without words give none."""
    return mixing.mix(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids' and decoded text's digests; a null text counts as empty."""
    return pieces.round_trip(docs, model_path(), keep=["doc_id", "source", "lang"], block_chars=4 << 20).select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of earlier stages are deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), set(written)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = [path for path in written if path not in before]
            docs = stored(docs)
            discard(spark, made)
    return docs
