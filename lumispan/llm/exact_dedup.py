"""Exact dedup with owners kept in Patricia tries.

Texts are equal when they match after deleting ``[\\x20\\x09-\\x0D]``. Every map task inserts its
texts into a compressed radix trie first, so a text that fills a third of the corpus leaves each
task once. The distinct byte strings then go to partitions by (length, content hash). There each
whole string is inserted into a trie whose terminal nodes hold the owner: the longest original,
then the smallest identifier. A trie over its memory limit spills its largest subtrees to an
unnamed task-local file; a lost executor loses nothing but that task. Owners of groups of two or
more are joined back to the documents by (digest, length), which adaptive execution can split. Groups are made
by whole strings; only that way back trusts the digest (SHA-256).

Defined results: a null text counts as empty; very long texts are read whole; a null id loses every
tie and, as the only id of a group, gives a null keep_id; repeated rows of one id and one text are one
document, so all of them are kept when that id is. Rows of one id with different texts are judged one
by one. An empty table gives an empty result. Extra columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, broadcast_if_small, every, quoted, releasing, scratch, small_batches, stored

#: Bytes of strings and nodes that a trie holds in memory.
TRIE_BYTES = 64 << 20
NODE_BYTES = 250


def normalise(text: bytes) -> bytes:
    return text.translate(None, SPACE_BYTES)


class _Node:
    __slots__ = ("label", "children", "owner", "spill")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.spill = label, {}, None, None


def better(a: tuple, b: tuple) -> tuple:
    """The owner of two (code points, id): more code points, then the smaller id; a null id comes last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _common(label: bytes, key: bytes, at: int) -> int:
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with an owner (code points, id), a count and a digest each.

    With ``spill``, the largest subtrees leave memory once ``limit`` bytes are held; later strings
    that reach such a subtree are appended to its file, and ``items`` builds it anew.
    """

    def __init__(self, limit: int = TRIE_BYTES, spill: bool = True):
        self.limit, self.may_spill, self.held, self.root, self.files = limit, spill, 0, _Node(b""), []

    def insert(self, key: bytes, owner: tuple, count: int, digest: bytes) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], owner, count, digest), node.spill)
                return
            if at == len(key):
                self._own(node, owner, count, digest)
                return
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                node.children[key[at]] = leaf
                self.held += len(leaf.label) + NODE_BYTES
                self._own(leaf, owner, count, digest)
                if self.may_spill and self.held > self.limit:
                    self._spill()
                return
            if not key.startswith(child.label, at):
                cut = _common(child.label, key, at)
                upper = _Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.held += NODE_BYTES
                child = upper
            at += len(child.label)
            node = child

    @staticmethod
    def _own(node: _Node, owner: tuple, count: int, digest: bytes) -> None:
        node.owner = (owner, count, digest) if node.owner is None else (better(node.owner[0], owner), node.owner[1] + count, digest)

    @staticmethod
    def _below(top: _Node) -> Iterator[tuple[bytes, _Node]]:
        """Nodes of a subtree, each with its string from below ``top``."""
        stack = [(b"", top)]
        while stack:
            path, node = stack.pop()
            yield path, node
            stack.extend((path + c.label, c) for c in node.children.values())

    def _spill(self) -> None:
        top = self.root
        while len(top.children) == 1 and top.owner is None and (only := next(iter(top.children.values()))).spill is None and only.children:
            top = only
        sizes = sorted(((sum(len(n.label) + NODE_BYTES for _, n in self._below(c)), k) for k, c in top.children.items() if c.spill is None), reverse=True)
        for size, k in sizes:
            if self.held <= self.limit // 2:
                break
            node = top.children[k]
            out = tempfile.TemporaryFile()
            for path, n in self._below(node):
                if n.owner is not None:
                    pickle.dump((path, *n.owner), out)
                if n.spill is not None:  # an older file below: its strings move up
                    n.spill.seek(0)
                    for rest, *owned in self._read(n.spill):
                        pickle.dump((path + rest, *owned), out)
                    n.spill.close()
            node.children, node.owner, node.spill = {}, None, out
            self.held -= size - len(node.label) - NODE_BYTES

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    def items(self) -> Iterator[tuple[bytes, tuple, int, bytes]]:
        """(string, owner, count, digest) of every distinct string; spilled subtrees one at a time."""
        spilled = []
        for path, node in self._below(self.root):
            if node.owner is not None:
                yield path, *node.owner
            if node.spill is not None:
                spilled.append((path, node.spill))
        self.root = _Node(b"")
        for path, file in spilled:
            file.seek(0)
            inner = PatriciaTrie(self.limit)
            for record in self._read(file):
                inner.insert(*record)
            file.close()
            for rest, *owned in inner.items():
                yield path + rest, *owned


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    schema = pa.schema(list(zip(names, types)))
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)


def owners(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = TRIE_BYTES) -> DataFrame:
    """(digest, n_bytes, keep_id, group_size): one row for each distinct normalised text."""
    small_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    @releasing
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = PatriciaTrie(spill=False)
            for batch in batches:
                for i, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                    key = normalise(text)
                    trie.insert(key, (n, i), 1, hashlib.sha256(key).digest())
                    if trie.held > limit // 3:
                        yield from flat(trie)
                        trie = PatriciaTrie(spill=False)
            yield from flat(trie)

        def flat(trie):
            for key, (n, i), count, digest in trie.items():
                yield len(key), int.from_bytes(digest[:8], "little", signed=True), key, digest, n, i, count

        yield from _batches(rows(), ["n_bytes", "hash", "key", "digest", "n", "id", "rows"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])

    @releasing
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit)
        for batch in batches:
            for key, digest, n, i, count in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(key, (n, i), count, digest)

        def rows():
            for key, (_, i), count, digest in trie.items():
                yield digest, len(key), i, count

        yield from _batches(rows(), ["digest", "n_bytes", "keep_id", "group_size"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()])

    parts = raw.mapInArrow(combine, "n_bytes long, hash long, key binary, digest binary, n long, id long, rows long")
    return parts.repartition("n_bytes", "hash").select("key", "digest", "n", "id", "rows").mapInArrow(own, "digest binary, n_bytes long, keep_id long, group_size long")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    shared = owners(docs, text_col, id_col, limit).filter("group_size > 1").withColumnRenamed("n_bytes", "bytes").withColumnRenamed("digest", "of")

    @releasing
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [normalise(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary()), pa.array(map(len, keys), pa.int64())], ["doc_id", "digest", "n_bytes"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(digests, "doc_id long, digest binary, n_bytes long")
    joined = keyed.join(shared, (F.col("digest") == F.col("of")) & (F.col("n_bytes") == F.col("bytes")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all columns.

    Only ids and digests of dropped rows travel; texts are shuffled again only if those are too many to broadcast.
    """
    gone, digest = scratch(docs, "_gone"), scratch(docs, "_digest")
    dropped = stored(exact_groups(docs, text_col, id_col).filter("not kept").select(F.col("doc_id").alias(gone), F.unhex("text_sha256").alias(digest)).distinct())
    own = F.unhex(F.sha2(F.regexp_replace(F.coalesce(quoted(text_col).cast("string"), F.lit("")), r"[ \t-\r]", ""), 256))
    return docs.join(broadcast_if_small(dropped), quoted(id_col).cast("long").eqNullSafe(F.col(gone)) & (own == F.col(digest)), "left_anti").select(*every(docs))
