"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of all word and line rules here; ``bytes.split()`` cuts at exactly these six bytes.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Above this many rows, or bytes of their values, nothing is broadcast.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
#: Tables that ``stored`` wrote in this process.
written: list[str] = []
#: Rows of one Arrow batch, so that a batch of very long texts stays within a worker's memory.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at once (a caller's own smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is not set, a local session takes a temporary one, a cluster raises ValueError."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="lumispan-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Unlike a checkpoint, the result has the size of its files as statistics; those of checkpoints multiply
    with each join, so that after many rounds the planner is busy with numbers of millions of digits.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``stored`` wrote, once nothing lazy depends on them."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in written:
            written.remove(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a materialised frame of few rows and bytes, both counted; else the frame as it is."""
    sizes = [F.lit(16) if isinstance(f.dataType, T.NumericType) else F.coalesce(F.octet_length(quoted(f.name).cast("string")), F.lit(0)) + 32 for f in df.schema]
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def quoted(name: str) -> Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """All columns of a frame, but those named (in any case)."""
    gone = {x.lower() for x in but}
    return [quoted(c) for c in df.columns if c.lower() not in gone]


def scratch(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one column, materialised); rows with a null id stay."""
    gone = scratch(docs, "_gone")
    return docs.join(broadcast_if_small(ids.select(F.col(ids.columns[0]).alias(gone))), quoted(id_col).cast("long") == F.col(gone), "left_anti").select(*every(docs))


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later tasks, beside other ones."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(function):
    """A generator over batches that calls ``release`` when its task is done."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run
