"""Live spans: the last write of each key, without deleted keys.

The compacted base holds one live row a key; the log holds everything written since. A base row is
live unless the log has its key, so filters reach the base's scan; only the log is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.schema import ARRIVAL, KEY

#: Log rows up to which their keys are broadcast; beyond, the anti-join is shuffled.
BROADCAST_KEYS = 500_000


def latest(log: DataFrame, key: list[str] = KEY, order: list[str] = ARRIVAL) -> DataFrame:
    """The last write of each key, tombstones included."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))
    return log.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def resolve(base: DataFrame | None, log: DataFrame | None, log_rows: int | None = None, key: list[str] = KEY, order: list[str] = ARRIVAL, deleted: str = "_deleted") -> DataFrame:
    """Live rows of a base and a newer log. Filter the result, never the log: Catalyst moves filters to the base.

    ``log_rows``: the known size of the log, from its commit; unknown sizes are not broadcast.
    """
    if log is None:
        return base
    last = latest(log, key, order)
    fresh = last.filter(~F.col(deleted))
    if base is None:
        return fresh
    keys = log.select(*key)
    keys = F.broadcast(keys) if log_rows is not None and log_rows <= BROADCAST_KEYS else keys
    return base.join(keys, key, "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))
