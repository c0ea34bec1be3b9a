"""SentencePiece encoding and decoding through a table of distinct chunks.

In the model's vocabulary the whitespace marker stands only at the front of a piece, so no merge
crosses from a word into the marker that follows; a text is cut before each run of markers. Blocks
of consecutive rows of a partition ask for their distinct chunks, dealt into buckets by a hash. A
bucket's task holds that part of the table: it segments each distinct chunk once, by the library
itself, and answers every block in the order asked. A block takes its ids back by position: the
answers go to the partition that asked and are zipped there with the rows, which are never shuffled.
A block asks for a chunk once, so a frequent chunk costs a bucket one entry a block; buckets grow with
the input.

Answers are written to the shared folder. Rows are read twice and must come alike: a plan with an
exchange is stored first, and a block whose chunks differ from those it asked for, or a partition with
other numbers of rows, fails the job. A bucket over CHUNK_BYTES forgets its chunks and segments them
again, so that memory is bounded; results don't change.

Defined results: a null text counts as empty and gives just the end id; ids are those of the library
with the end id added and no sampling. Rows are independent, so repeated rows give equal results.
An empty table gives an empty result. Extra columns stay, and an input column named like an output
column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import every, quoted, release, releasing, small_batches, stored

MARK = "▁"
CHUNK_BYTES = 64 << 20
#: A block is full at so many characters, each row counting as ROW_CHARS more.
BLOCK_CHARS, ROW_CHARS = 16 << 20, 64
#: Buckets of the table for each partition of the input, and bounds on their number.
SPREAD, LEAST_BUCKETS, MOST_BUCKETS = 2, 16, 1 << 16
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[str, "ChunkCodec"] = {}


class ChunkCodec:
    """Encodes and decodes by chunks; raises ValueError for a model whose pieces or rules don't allow it."""

    def __init__(self, model_path: str, limit: int = CHUNK_BYTES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces) or MARK not in pieces:
            raise ValueError("pieces of this model cross whitespace markers")
        if self.library.encode(" a  b") != self.library.encode(f"{MARK}a{MARK}{MARK}b") or self.library.decode(self.library.encode("  a\néＡ ")) != "  a\néＡ ":
            raise ValueError("this model changes white space or characters")
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.names = [str(i) for i in range(len(pieces))]
        self.end, self.limit = str(self.library.eos_id()), limit
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.held = 0

    def _learn(self, new: list[str]) -> None:
        """Segment chunks that the table lacks, those with one marker all in one call.

        Each of those opens with the only piece of it that has a marker, so ids fall apart there, and decoded text at spaces.
        """
        plain = [c for c in new if MARK not in c[1:2] and len(c) > 1 and " " not in c]
        if plain:
            # the library adds the first marker itself, and takes spaces for markers
            ids = self.library.encode("".join(plain)[1:])
            at = np.flatnonzero(self.opens[np.array(ids)]).tolist()
            texts = self.library.decode(ids).split(" ")
            if len(at) != len(plain) or len(texts) != len(plain):
                raise ValueError("chunks of this model cannot be told apart")
            names = [self.names[i] for i in ids]
            for chunk, a, b, text in zip(plain, at, [*at[1:], len(ids)], texts):
                self.ids[chunk] = " ".join(names[a:b])
                self.texts[chunk] = " " + text
        for chunk in new:
            if chunk not in self.ids:
                ids = [self.library.piece_to_id(MARK)] if chunk == MARK else self.library.encode(chunk[1:])
                self.ids[chunk] = " ".join(self.names[i] for i in ids)
                self.texts[chunk] = " " + self.library.decode(ids)
        self.held += sum(map(len, new)) * 4 + 220 * len(new)

    def _chunks(self, text: str) -> list[str]:
        if MARK in text or "  " in text or "\0" in text or text[:1] == " ":
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", "\0" + MARK)).split("\0") if text else []

    def segment(self, chunks: list[str]) -> tuple[list[str], dict[int, str]]:
        """Ids of each chunk, and the decoded texts, by position, of those that don't decode to themselves."""
        if self.held > self.limit:
            self._forget()
        if new := [c for c in chunks if c not in self.ids]:
            self._learn(new)
        return [self.ids[c] for c in chunks], {k: self.texts[c] for k, c in enumerate(chunks) if self.texts[c] != c.replace(MARK, " ")}

    def wanted(self, texts: Iterable[str], buckets: int) -> dict[int, list[str]]:
        """The distinct chunks of some texts by bucket, each bucket in order of first occurrence; at least one bucket."""
        seen: dict[str, None] = {}
        for text in texts:
            seen.update(dict.fromkeys(self._chunks(text)))
        out: dict[int, list[str]] = {}
        for chunk in seen:
            out.setdefault(zlib.crc32(chunk.encode()) % buckets, []).append(chunk)
        return out or {0: []}

    def digest(self, text: str, ids: dict[str, str], odd: dict[str, str]) -> tuple[str, str]:
        """(decimal ids joined by spaces, end id included; decoded text) of a whole text whose chunks are in ``ids``."""
        chunks = self._chunks(text)
        plain = not odd or odd.keys().isdisjoint(chunks)
        decoded = text.replace(MARK, " ") if plain else "".join([odd.get(c) or c.replace(MARK, " ") for c in chunks])[1:]
        return " ".join([ids[c] for c in chunks] + [self.end]), decoded


def codec(model_path: str) -> ChunkCodec:
    """One codec for each model in each worker."""
    if model_path not in _codecs:
        _codecs[model_path] = ChunkCodec(model_path)
    return _codecs[model_path]


def _forget(model_path: str) -> None:
    """Empty the table when a task is done."""
    codec(model_path)._forget()
    release()


def _packed(value: object) -> bytes:
    return zlib.compress(json.dumps(value, ensure_ascii=False).encode(), 1)


def _unpacked(blob: bytes) -> object:
    return json.loads(zlib.decompress(blob))


def _mark(chunks: list[str]) -> int:
    """A checksum that tells whether a block asks for the same chunks again."""
    return zlib.crc32("".join(chunks).encode())


_PARTS = "at int, block int, rows int, bucket int, mark long, chunks binary"
_ARROW = pa.schema([("at", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()), ("bucket", pa.int32()), ("mark", pa.int64()), ("chunks", pa.binary())])


def _blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[tuple[pa.RecordBatch, list[str]]]]:
    """Consecutive rows in blocks of some ``limit`` characters: slices of batches with their texts, column "text", null as empty."""
    held: list[tuple[pa.RecordBatch, list[str]]] = []
    chars = 0
    for batch in batches:
        texts, start = [text or "" for text in batch.column("text").to_pylist()], 0
        for k, text in enumerate(texts):
            chars += len(text) + ROW_CHARS
            if chars >= limit:
                yield [*held, (batch.slice(start, k + 1 - start), texts[start : k + 1])]
                held, chars, start = [], 0, k + 1
        if start < len(texts):
            held.append((batch.slice(start), texts[start:]))
    if held:
        yield held


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of two frames side by side, by position; both have the same partitions with the same numbers of rows.

    Rows are zipped in the JVM and stay there: no Python worker holds them.
    """
    spark = left.sparkSession
    rows = spark.sparkContext._jvm.org.apache.spark.sql.Encoders
    pairs = left._jdf.toJavaRDD().zip(right._jdf.toJavaRDD()).rdd()
    zipped = spark._jsparkSession.createDataset(pairs, rows.tuple(rows.row(left._jdf.schema()), rows.row(right._jdf.schema())))
    return DataFrame(zipped.toDF(), spark).select("_1.*", "_2.*")


def _joined(docs: DataFrame, model_path: str, text_col: str, keep: list[str], made: list[T.StructField], finish: Callable[[str, str], tuple], block_chars: int | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what ``finish`` makes of each text's ids and decoded text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(keep)), quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"m{k}", f.dataType) for k, f in enumerate(made))])
    names = [*keep, *(f.name for f in made)]
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = stored(rows)
    parts = rows.rdd.getNumPartitions()
    if parts == 0:
        return spark.createDataFrame([], schema).toDF(*names)
    buckets, limit = min(MOST_BUCKETS, max(LEAST_BUCKETS, SPREAD * parts)), block_chars or BLOCK_CHARS
    types = [to_arrow_type(f.dataType) for f in made]

    @releasing
    def ask(batches):
        table, at = codec(model_path), TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(batches, limit)):
            n = sum(len(texts) for _, texts in block)
            asked = table.wanted((text for _, texts in block for text in texts), buckets)
            yield pa.RecordBatch.from_pylist([{"at": at, "block": k, "rows": n, "bucket": b, "mark": _mark(chunks), "chunks": _packed(chunks)} for b, chunks in asked.items()], _ARROW)

    def segment(batches):
        table, last = codec(model_path), None
        try:
            for batch in batches:
                for part in range(batch.num_rows):
                    row = batch.slice(part, 1).to_pylist()[0]
                    if row["bucket"] != last:
                        table._forget()
                        last = row["bucket"]
                    yield pa.RecordBatch.from_pylist([row | {"chunks": _packed(table.segment(_unpacked(row["chunks"])))}], _ARROW)
        finally:
            _forget(model_path)

    @releasing
    def join(batches):
        table = codec(model_path)
        for block in _blocks(batches, limit):
            answers = {x["bucket"]: x for x in block[0][0].column("found")[0].as_py() or []}
            ids: dict[str, str] = {}
            odd: dict[str, str] = {}
            for bucket, chunks in table.wanted((text for _, texts in block for text in texts), buckets).items():
                answer = answers.pop(bucket, None)
                if answer is None or answer["mark"] != _mark(chunks):
                    raise RuntimeError("rows differ between two readings of the table")
                found, others = _unpacked(answer["chunks"])
                ids.update(zip(chunks, found))
                odd.update((chunks[int(k)], text) for k, text in others.items())
            for batch, texts in block:
                values = list(zip(*(finish(*table.digest(text, ids, odd)) for text in texts)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, values, types)], schema.names)

    tasks = min(buckets, 8192)
    asked = rows.mapInArrow(ask, _PARTS).repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket")
    # written, so that a lost executor costs no chunk a second segmentation
    answers = stored(asked.mapInArrow(segment, _PARTS)).repartitionById(parts, F.col("at"))
    # a block's answers stand in its first row, nulls in its other ones
    blocks = answers.groupBy("at", "block").agg(F.collect_list(F.struct("bucket", "mark", "chunks")).alias("found"), F.first("rows").alias("rows")).sortWithinPartitions("block")
    lines = blocks.select("found", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("line")).select(F.when(F.col("line") == 1, F.col("found")).alias("found"))
    return _beside(rows, lines).mapInArrow(join, schema).toDF(*names)


def _kept(docs: DataFrame, keep: list[str] | None, made: tuple[str, ...]) -> list[str]:
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with an array of ids for each whole text, end id included."""
    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    return _joined(docs, model_path, text_col, _kept(docs, keep, (ids_col.lower(),)), made, lambda ids, _: (np.array(ids.split(), np.int32),))


def decode(docs: DataFrame, model_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids; a null array gives an empty text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        library = codec(model_path).library
        return pd.Series([library.decode([] if x is None else [int(i) for i in x]) for x in ids])

    return docs.select(*every(docs, (text_col,)), text(quoted(ids_col)).alias(text_col))


def _digests(ids: str, text: str) -> tuple[int, str, str]:
    return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, block_chars: int | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with n_tokens, ids_sha256 and decoded_sha256, without storing the ids.

    Smaller blocks take less memory and ask for more chunks.
    """
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _joined(docs, model_path, text_col, _kept(docs, keep, tuple(f.name for f in made)), made, _digests, block_chars)
