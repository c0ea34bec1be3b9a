"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation whose turns are the first turns of a longer one is a snapshot of it and goes;
of equal conversations the smallest id stays. Prefixes are recognised by rolling hashes: the
exclusive-or, over the turns so far, of two 64-bit hashes of (position, SHA-256 of role and text).
All of this works on digests; texts travel once, for the conversations that stay. Turns are
range-partitioned in order, so a conversation that fills many partitions has a block in each of
them; only conversations that span partitions, at most one a border, carry a count and a hash from
block to block. Prefixes are aggregated before they meet full conversations in an anti-join, and a
conversation only goes once all its turns' digests equal those of the one that it is thought to
repeat.

The rest is rendered, one text a conversation. A conversation of more than ``part_turns`` turns comes
in parts of that many, so that no row grows without bound.

Defined results: turns are ordered by (turn with nulls first, role, SHA-256 of role and text); fully
repeated rows count once; a null role is ``unknown`` and a null text empty; rows with a null
conversation id are ignored; template markers within a text are broken up; very long texts are kept
whole. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

#: Turns of one rendered text.
PART = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = ["conv_id", "turn", "role", "digest"]


def _clean(name: str, empty: str) -> Column:
    return F.replace(F.coalesce(F.col(name).cast("string"), F.lit(empty)), F.lit("<|im_"), F.lit("<| im_"))


def cleaned(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, digest, text of every row with a conversation id."""
    t = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _clean(role_col, "unknown").alias("role"), _clean(text_col, "").alias("text"))
    return t.select("conv_id", "turn", "role", F.unhex(F.sha2(F.concat("role", F.lit("\n"), "text"), 256)).alias("digest"), "text")


def numbered(clean: DataFrame) -> DataFrame:
    """TURN, n (turns of the conversation), at (1, 2, ...) and the hashes h1, h2 of the prefix that ends here; materialised."""
    tasks = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = stored(clean.select(*TURN).distinct())
    t = stored(t.repartitionByRange(tasks, *TURN).withColumn("block", F.spark_partition_id()))
    by_conv, in_block = W.partitionBy("conv_id"), W.partitionBy("conv_id", "block")
    earlier = by_conv.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # conversations in several blocks: a range border each, so these frames have at most twice as many rows as there are blocks
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("rows")).withColumn("blocks", F.count("*").over(by_conv)).filter("blocks > 1")
    sizes = stored(sizes.select("conv_id", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(by_conv).alias("all")))
    t = t.withColumns({"at": F.row_number().over(in_block.orderBy("turn", "role", "digest")), "n": F.count("*").over(in_block)})
    t = t.join(F.broadcast(sizes), ["conv_id", "block"], "left")
    t = t.select(*TURN, "block", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), F.coalesce("all", "n").alias("n"))
    t = t.withColumns({"t1": F.xxhash64(F.lit(11), "at", "digest"), "t2": F.xxhash64(F.lit(23), "digest", "at")})
    running = in_block.orderBy("turn", "role", "digest").rowsBetween(W.unboundedPreceding, 0)
    t = stored(t.select(*TURN, "block", "at", "n", "t1", "t2", F.bit_xor("t1").over(running).alias("r1"), F.bit_xor("t2").over(running).alias("r2")))
    sums = t.join(F.broadcast(sizes.select("conv_id", "block")), ["conv_id", "block"], "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    carried = sums.select("conv_id", "block", F.bit_xor("x1").over(earlier).alias("c1"), F.bit_xor("x2").over(earlier).alias("c2"))
    t = t.join(F.broadcast(carried), ["conv_id", "block"], "left")
    return t.select(*TURN, "n", "at", *(F.col(f"r{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0).cast("long"))).alias(f"h{k}") for k in (1, 2)))


def repeated(t: DataFrame) -> DataFrame:
    """conv_id of the conversations in ``numbered`` that are snapshots of a longer one, or copies of one with a smaller id."""
    key = ["n", "h1", "h2"]
    prefixes = t.filter("at < n").groupBy(F.col("at").alias("n"), "h1", "h2").agg(F.min("conv_id").alias("longer"))
    whole = t.filter("at = n").select("conv_id", *key)
    first = whole.groupBy(*key).agg(F.min("conv_id").alias("first"), F.count("*").alias("copies"))
    # what a conversation would repeat; of the others most have neither
    of = first.join(prefixes, key, "left").filter("longer is not null or copies > 1").select(*key, F.coalesce("longer", "first").alias("other"))
    thought = stored(whole.join(broadcast_if_small(stored(of)), key).filter("conv_id != other").select("conv_id", "n", "other"))
    mine = t.select("conv_id", "at", "digest").join(broadcast_if_small(thought), "conv_id").select("conv_id", "n", F.col("other").alias("other_id"), F.col("at").alias("at_of"), F.col("digest").alias("mine"))
    same = mine.join(t.select(F.col("conv_id").alias("id"), "at", "digest"), (F.col("other_id") == F.col("id")) & (F.col("at_of") == F.col("at")) & (F.col("mine") == F.col("digest")))
    return same.groupBy("conv_id").agg(F.count("*").alias("equal"), F.first("n").alias("n")).filter("equal = n").select("conv_id")


def render(turns: DataFrame, part_turns: int = PART, **columns) -> DataFrame:
    """conv_id, part (0, 1, ...), n_turns (of the part), rendered: the maximal conversations as chat text."""
    clean = cleaned(turns, **columns)
    t = stored(numbered(clean))
    sizes = t.filter("at = n").select("conv_id", "n")
    kept = stored(sizes.join(broadcast_if_small(stored(repeated(t))), "conv_id", "left_anti"))
    chunk = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n")).alias("chunk")
    short, long = kept.filter(F.col("n") <= part_turns).select("conv_id"), kept.filter(F.col("n") > part_turns).select("conv_id")
    # a set of at most part_turns turns: repeated rows are gone before they travel
    parts = clean.join(broadcast_if_small(short), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "digest", chunk))).alias("chunks"))
    parts = parts.select("conv_id", F.lit(0).cast("long").alias("part"), "chunks.chunk")
    if not long.isEmpty():
        once = clean.join(broadcast_if_small(long), "conv_id", "left_semi").groupBy(*TURN).agg(F.first("text").alias("text"))
        # turns may be null, which a join's equality takes for unknown
        shown = once.withColumns({"turn": F.coalesce("turn", F.lit(0).cast("long")), "unset": F.col("turn").isNull()})
        places = t.join(broadcast_if_small(long), "conv_id", "left_semi").select("conv_id", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNull().alias("unset"), "role", "digest", "at")
        placed = shown.join(places, ["conv_id", "turn", "unset", "role", "digest"])
        cut = placed.groupBy("conv_id", F.floor((F.col("at") - 1) / part_turns).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", chunk))).alias("chunks"))
        parts = parts.unionByName(cut.select("conv_id", "part", "chunks.chunk"))
    return parts.select("conv_id", "part", F.size("chunk").cast("long").alias("n_turns"), F.array_join("chunk", "").alias("rendered"))
