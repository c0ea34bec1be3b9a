"""Mixing sources to target weights, in DataFrame functions only.

Word counts are summed up per source; weights share out a budget of ``share`` times all words, and no
source goes beyond ``most`` times its own (water level: the excess goes to the others by weight).
A document is emitted floor(rate) times, plus once more when a number in [0, 1) hashed from the seed
and its id lies below the rate's fraction.

Defined results: a null or empty text has size 0 and is taken 0 words (its copies follow its source's
rate); a null source is a source of its own, last in order; repeated rows with one id draw the same
number; sources without words have target 0 and rate 0. An empty table gives an empty result. Extra
columns stay; ``repetitions`` replaces an input column named like one of its own, ``mix`` changes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, broadcast_if_small, every, quoted, stored

WEIGHTS = (5, 2, 1)
MADE = ("size", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN + "+")), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The windows without a key run over the table of sources, one row each.
    """
    every = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    s = s.select("*", (F.col("cap") / F.col("w")).alias("ratio"), F.sum("w").over(every).alias("all_w"), F.sum("source_size").over(every).alias("all_size"))
    earlier = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    # the level if just the sources before this one were at their caps; the highest of these levels holds
    level = (F.col("all_size") * share - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    s = s.select("*", level.alias("level")).select("*", F.max("level").over(every).alias("top"))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("top") * F.col("w")).alias("target"))


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(of, source_size, target, rate) of each source, from (source, size) rows; materialised, one row a source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stored(source_targets(sizes, weights, share, most).select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate")))


def copies(rate: Column, key: Column, seed: int) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(key, seed) < rate - whole).cast("long")).cast("long")


def repetitions(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", size_col: str | None = None, seed: int = 42, **options) -> DataFrame:
    """``docs`` with size, source_size, target (both of its source), rate and copies.

    ``size_col`` names a column with sizes that are known already, so that texts aren't counted again.
    """
    size = quoted(size_col).cast("long") if size_col else word_count(quoted(text_col))
    row = docs.select(F.struct(*every(docs, MADE)).alias("row"), quoted(source_col).cast("string").alias("source"), quoted(id_col).alias("id"), size.alias("size"))
    plan = rates(row.select("source", "size"), **options)
    joined = row.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("row.*", "size", "source_size", "target", "rate", copies(F.col("rate"), F.col("id"), seed).alias("copies"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 42, **options) -> DataFrame:
    """The mixed rows themselves, with all columns of ``docs`` as they are: each document as often as its copies say."""
    plan = rates(docs.select(quoted(source_col).cast("string").alias("source"), word_count(quoted(text_col)).alias("size")), **options)
    row = docs.select(F.struct(*every(docs)).alias("row"), quoted(source_col).cast("string").alias("source"), quoted(id_col).alias("id"))
    joined = row.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("of")))
    taken = joined.select("row", copies(F.col("rate"), F.col("id"), seed).alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
