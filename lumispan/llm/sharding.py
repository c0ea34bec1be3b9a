"""Sharding by global prefix sums of byte sizes.

Documents are range-partitioned by id once, without their texts. Each partition reports its total
size and row count; the running sums of those totals (one pair per partition) place every partition
on one global line, which is cut at equal targets into contiguous shards. So neither a hot key nor
a long text meets more than its own partition.

Defined results: the order is (id with nulls first, text CRC, size); rows equal in all three are
interchangeable. A null text has size 1. Sizes of shards differ by at most the largest document on
either side. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def balanced_shards(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; slots of a shard run from 0 without gaps."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # a random last key deals out rows that are equal in all others
    ranged = sized.withColumn("_deal", F.rand(7)).repartitionByRange(n, "doc_id", "text_crc32", "size", "_deal").sortWithinPartitions("doc_id", "text_crc32", "size", "_deal")
    line = checkpoint(ranged.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part")))
    totals = {r["part"]: r["total"] for r in line.groupBy("part").agg(F.sum("size").alias("total")).collect()}  # one row a partition
    whole = sum(totals.values())
    parts = sorted(totals)
    before = dict(zip(parts, accumulate([0, *(totals[p] for p in parts)])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).to_numpy(zero_copy_only=False)
            at = before[batch.column(3)[0].as_py()] if at is None else at
            starts = at + np.cumsum(size) - size
            at += int(size.sum())
            # Python integers where starts * shards may not fit
            shard = starts * shards // whole if whole * shards < 1 << 62 else np.array([int(s) * shards // whole for s in starts], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))], ["doc_id", "size", "text_crc32", "part", "shard"])

    placed = line.mapInArrow(place, "doc_id long, size long, text_crc32 long, part int, shard int")
    # rows of each shard in each partition: at most partitions + shards rows
    cells = {(r["part"], r["shard"]): r["n"] for r in placed.groupBy("part", "shard").agg(F.count("*").alias("n")).collect()}
    first, seen = {}, dict.fromkeys(range(shards), 0)
    for p, s in sorted(cells):
        first[p, s] = seen[s]
        seen[s] += cells[p, s]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_slot: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, shard = batch.column(3)[0].as_py(), batch.column(4).to_numpy()
            slot = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                mine = shard == s
                at = next_slot.get((part, int(s)), first[part, int(s)])
                slot[mine] = at + np.arange(mine.sum())
                next_slot[part, int(s)] = at + int(mine.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    return placed.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, slot long")
