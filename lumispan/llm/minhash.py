"""MinHash near-dedup over an LSH forest, made exact where its regions are overfull.

Signatures come from one pass over the texts. Equal shingle sets collapse to one representative. For
each of TREES sorted orders, the representatives are range-partitioned and sorted by a label of DEPTH
min-hash values, so rows with the longest common prefixes are neighbours. The depth adapts to the
region: where at most REGION rows share a prefix, all of them are candidates of each other, however
short the prefix; a larger region is left to its longer prefixes, and there each row meets its
direct neighbour (in every other order) and the region's one or two hubs, the rows closest to the
region's most common min-hash values (in a cluster of altered copies, the original; of tied rows, each
order takes the next ones). So candidates grow with the rows, never with the square of a group.
Candidates must agree in a 64-sample sketch (five standard deviations below the threshold) and in size.

Links are confirmed on full shingle sets, first each row's best partner, then, once components of
those are known, only pairs that still lie in different components.

Rows that a region of full depth, a partition's border or a chunk's border kept from some of their
neighbours are marked, and the links between marked rows are then found exactly: shingles are ordered
from rare to frequent among the marked sets, two sets that are similar enough share one within the
first few of each (prefix and position filter), and pairs that share such a shingle, but no component,
are confirmed too. A shingle's largest component is met only by rows outside of it, never by itself.
What remains to chance is a pair that shares no label at all in any order, as in any LSH forest.

Components are computed in DataFrame rounds. Links, sets and components stay distributed; sets travel
to cells of pairs, at most once to each.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is five words; a text with fewer
words is one shingle; similarity is intersection over union of distinct shingles (64-bit hashes).

Defined results: a text without words, or null, has no shingles and links with nothing; a null id
links with nothing, has a null component and is kept; repeated rows with one id are one document, and
one of its texts counts; very long texts are read whole. An empty table gives an empty result. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, releasing, small_batches, stored, without_ids
from .components import components

WORDS = 5
TREES, DEPTH = 16, 4
SAMPLES = TREES * DEPTH
REGION = 16
#: Hubs of a region in even and odd sorted orders.
HUBS = (2, 1)
#: A region inside another one takes hubs of its own if it is smaller by this factor.
NESTED = 4
#: Equal 4-bit samples of 64 that a candidate needs; similarity 0.75 gives 49 on average, standard deviation 3.4.
AGREE = 33
SLICE = 1 << 20
CHUNK_ROWS = 1 << 19
#: Rows of one partition of the forest; few boundaries cut few regions.
PARTITION_ROWS = 300_000
#: A cell of pairs to confirm holds about this many bytes of sets and this many pairs.
CELL_BYTES, CELL_PAIRS = 32 << 20, 1_000_000
#: Rows of one shingle that meet in one task, on either side.
HOT_ROWS = 1024

_U64 = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U64(33)
    h *= _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(33)
    h *= _U64(0xC4CEB9FE1A85EC53)
    h ^= h >> _U64(33)
    return h


def _constants(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15) + _U64(salt))


_BASE = 0xD1342543DE82EF95
_BYTES = _constants(256, 1)
_MULTIPLY, _ADD = _constants(SAMPLES, 2) | _U64(1), _constants(SAMPLES, 3)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_EQUAL_NIBBLES = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + SLICE // 2)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ p) * _U64(0x9FB21C651E98DF25)
        h ^= h >> _U64(29)
    return _mix(h)


def _slice_shingles(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # a word starts, ends, starts, ...
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power, out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    n = len(words)
    grams = _fold([words[k : n - WORDS + 1 + k] for k in range(WORDS)]) if n >= WORDS else np.zeros(0, np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            out.append(_fold([words[i : i + 1] for i in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of whole texts, in runs of about SLICE bytes; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SLICE):
            size += len(texts[upto])
            upto += 1
        yield _slice_shingles(texts[at:upto])
        at = upto


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES min-hash values (32 bits) of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SAMPLES), np.uint32)
    work, top = np.empty_like(flat), np.empty(len(flat), np.uint32)
    for k in range(SAMPLES):
        np.multiply(flat, _MULTIPLY[k], out=work)
        work += _ADD[k]
        work >>= _U64(32)
        top[:] = work
        out[:, k] = np.minimum.reduceat(top, starts)
    return out


def _labels(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TREES labels of DEPTH 16-bit values as signed 64-bit numbers, and a sketch of SAMPLES 4-bit values in bytes."""
    spread = minima * np.uint32(0x9E3779B1)
    spread ^= spread >> np.uint32(15)
    spread *= np.uint32(0x85EBCA77)
    levels = (spread >> np.uint32(16)).astype(np.uint64).reshape(-1, TREES, DEPTH)
    labels = np.zeros(levels.shape[:2], np.uint64)
    for d in range(DEPTH):
        labels = (labels << _U64(16)) | levels[:, :, d]
    nibble = ((spread >> np.uint32(8)) & np.uint32(15)).astype(np.uint8)
    return labels.view(np.int64), nibble[:, 0::2] | (nibble[:, 1::2] << np.uint8(4))


def _binary(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint of the whole set), labels, sketch (empty for an empty set)."""

    @releasing
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(at, len(sets))
                at += len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                labels, sketch = _labels(_minima([sets[i] for i in full])) if full else (np.zeros((0, TREES), np.int64), np.zeros((0, SAMPLES // 2), np.uint8))
                prints, rows, sketches = np.zeros((len(sets), 2), np.int64), [[]] * len(sets), [b""] * len(sets)
                for k, i in enumerate(full):
                    prints[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                    rows[i], sketches[i] = labels[k], sketch[k].tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(rows, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "n", "f1", "f2", "labels", "sketch"])

    return _binary(docs, text_col, id_col).mapInArrow(sign, "id long, n long, f1 long, f2 long, labels array<long>, sketch binary")


def _runs(tree: np.ndarray, label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal prefixes of ``depth`` levels, and the length of the run at each row."""
    prefix = label >> _U64(16 * (DEPTH - depth))
    first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1]))))
    return first, np.repeat(np.diff(np.append(first, len(label))), np.diff(np.append(first, len(label))))


def _agreement(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _EQUAL_NIBBLES[sketch[i] ^ sketch[j]].sum(axis=1, dtype=np.int32)


def exposed(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows, sorted by tree and label, whose region is overfull at full depth or may go on beyond the first or last row."""
    out = _runs(tree, label, DEPTH)[1] > REGION
    top = label >> _U64(16 * (DEPTH - 1))
    for edge, part in ((0, slice(0, REGION)), (-1, slice(-REGION, None))):
        out[part] |= (top[part] == top[edge]) & (tree[part] == tree[edge])
    return np.flatnonzero(out)


def neighbours(tree: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: np.ndarray, hubs: tuple[int, int] = HUBS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate rows (i, j), their agreement, and whether i is a hub, of rows sorted by tree and label."""
    runs = [_runs(tree, label, d) for d in range(1, DEPTH + 1)]
    pairs = []
    for step in range(1, min(REGION, len(label))):
        i = np.arange(len(label) - step)
        differ = label[:-step] ^ label[step:]
        near = np.zeros(len(i), bool)
        for d in range(DEPTH, 0, -1):
            shared = differ >> _U64(16 * (DEPTH - d)) == 0
            # in a large region, direct neighbours in every other order
            near |= shared & ((runs[d - 1][1][:-step] <= REGION) | ((step == 1) & (tree[:-step] % 2 == 0)))
        near &= tree[:-step] == tree[step:]
        i = i[near]
        if len(i):
            pairs.append((i, i + step, np.zeros(len(i), bool)))
    hosts = np.full(len(label), NESTED * len(label))  # size of the last region around each row that chose hubs
    for first, length in runs:
        for a in first[length[first] > REGION].tolist():
            b = a + int(length[a])
            if NESTED * (b - a) > hosts[a]:
                continue  # the hubs of the region around it have met all these rows
            hosts[a:b] = b - a
            part = sketch[a:b]
            nibbles = np.stack((part & 15, part >> 4), axis=2).reshape(b - a, SAMPLES).astype(np.int32)
            counts = np.bincount((nibbles + 16 * np.arange(SAMPLES, dtype=np.int32)).ravel(), minlength=16 * SAMPLES).reshape(SAMPLES, 16)
            central = (nibbles == counts.argmax(axis=1)).sum(axis=1)
            order = np.argsort(-central, kind="stable")
            tied = int((central == central[order[0]]).sum())
            # tied rows have equal labels, so they meet again in every order: take turns
            t, many = int(tree[a]), hubs[int(tree[a]) % 2]
            turn = (t // 2 * sum(hubs) + t % 2 * hubs[0]) % tied
            order = np.concatenate((np.roll(order[:tied], -turn), order[tied:]))
            rows = np.arange(a, b)
            pairs += [(np.full(b - a, a + k), rows, np.ones(b - a, bool)) for k in order[:many].tolist()]
    if not pairs:
        return (np.zeros(0, np.int64),) * 4
    i, j, hub = (np.concatenate(x) for x in zip(*pairs))
    fits = (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (i != j)
    i, j, hub = i[fits], j[fits], hub[fits]
    agree = np.concatenate([np.zeros(0, np.int32), *(_agreement(sketch, i[k : k + 200_000], j[k : k + 200_000]) for k in range(0, len(i), 200_000))])
    ok = agree >= AGREE
    return i[ok], j[ok], agree[ok], hub[ok]


def candidates(reps: DataFrame, rows: int) -> DataFrame:
    """(a, b, agree) with a < b, from (rep, n, labels, sketch) of distinct sets, and (a, a, 0) for each exposed row."""
    forest = reps.select("rep", "n", "sketch", F.posexplode("labels").alias("tree", "label"))
    parts = -(-rows * TREES // PARTITION_ROWS) or 1
    ordered = forest.repartitionByRange(parts, "tree", "label", "n", "rep").sortWithinPartitions("tree", "label", "n", "rep").select("tree", "label", "n", "rep", "sketch")

    @releasing
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            tree, label, n, rep = (t.column(k).to_numpy() for k in range(4))
            sketch = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(-1, SAMPLES // 2)
            label = label.astype(np.int64).view(np.uint64)
            i, j, agree, _ = neighbours(tree, label, n, sketch)
            lone = exposed(tree, label)
            a, b = np.concatenate((np.minimum(rep[i], rep[j]), rep[lone])), np.concatenate((np.maximum(rep[i], rep[j]), rep[lone]))
            agree = np.concatenate((agree, np.zeros(len(lone), agree.dtype))).astype(np.int32)
            # tied rows of one set in several trees meet here too; only an exposed row pairs with itself
            real = np.concatenate((rep[i] != rep[j], np.ones(len(lone), bool)))
            a, b, agree = a[real], b[real], agree[real]
            if len(a):
                order = np.lexsort((b, a))
                a, b, agree = a[order], b[order], agree[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (a, b, agree)], ["a", "b", "agree"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK_ROWS:
                yield from flush()
                held = [pa.Table.from_batches(held).slice(sum(x.num_rows for x in held) - REGION).combine_chunks().to_batches()[0]]
        if held:
            yield from flush()

    return ordered.mapInArrow(scan, "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def sets_of(docs: DataFrame, ids: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, n, shingles) of the documents in ``ids`` (one column ``id``, materialised): whole sets, sorted as unsigned numbers."""
    raw = _binary(docs, text_col, id_col).join(broadcast_if_small(ids), "id", "left_semi")

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in shingle_sets(batch.column(1).to_pylist()):
                sizes = [len(x) for x in found]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array(sizes, pa.int64()), values], ["id", "n", "shingles"])
                at += len(found)

    # repeated rows of one id become one
    return raw.mapInArrow(sets, "id long, n long, shingles array<long>").groupBy("id").agg(F.max(F.struct("n", "shingles")).alias("s")).select("id", "s.n", "s.shingles")


def forest_links(ids: np.ndarray, offsets: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks those pairs (a, b) with 100 * intersection >= 75 * union that join two trees of the forest they make.

    Sets are slices of ``values``. A pair within one tree is not compared: it links nothing new.
    """
    order = np.argsort(ids, kind="stable")
    x, y = (order[np.searchsorted(ids, v, sorter=order)] for v in (a, b))
    size = np.diff(offsets)
    by = np.argsort(x, kind="stable")
    out = np.zeros(len(a), bool)
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = np.flatnonzero(np.concatenate(([True], np.diff(x[by]) != 0, [True])))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        me = int(x[by[low]])
        one = values[offsets[me] : offsets[me + 1]]
        while low < high:
            upto = max(low + 1, low + int(np.searchsorted(np.cumsum(size[y[by[low:high]]]), 1 << 18)))
            mine = root(me)
            rows = [r for r in by[low:upto].tolist() if root(int(y[r])) != mine]
            low = upto
            if not rows:
                continue
            others = np.concatenate([values[offsets[k] : offsets[k + 1]] for k in y[rows].tolist()])
            at = np.searchsorted(one, others)
            at[at == len(one)] = 0
            lengths = size[y[rows]]
            shared = np.add.reduceat((one[at] == others).astype(np.int64), np.cumsum(lengths) - lengths)
            for r in np.array(rows)[7 * shared >= 3 * (lengths + len(one))].tolist():
                p, q = root(me), root(int(y[r]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out[r] = True
    return out


def _tasks(df: DataFrame) -> int:
    """Tasks for work that grows faster than the bytes it reads, so that adaptive execution must not merge its partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def confirm(pairs: DataFrame, sets: DataFrame, n_pairs: int, set_bytes: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (materialised) whose whole shingle sets have 100 * intersection >= 75 * union.

    All such pairs are connected by the links given, which are a forest in each cell. Ids are dealt into buckets by a hash; a cell holds the pairs of two buckets and each set that they need, once.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    buckets = max(math.ceil(2 * set_bytes / CELL_BYTES), math.ceil(math.sqrt(2 * n_pairs / CELL_PAIRS)), math.ceil(math.sqrt(4 * cores)) if n_pairs > 1000 else 1)
    at = lambda c: F.pmod(F.xxhash64(F.lit(31), F.col(c)), F.lit(buckets))
    placed = pairs.select("a", "b", F.least(at("a"), at("b")).alias("low"), F.greatest(at("a"), at("b")).alias("high"))
    needs = placed.select("low", "high", F.col("a").alias("id")).unionAll(placed.select("low", "high", F.col("b").alias("id"))).distinct()
    shipped = needs.join(sets.select("id", "shingles"), "id").select(F.col("low").alias("low_s"), F.col("high").alias("high_s"), "id", "shingles")

    def compare(there: pa.Table, asked: pa.Table) -> pa.Table:
        lists = there.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        ok = forest_links(there.column("id").to_numpy(), lists.offsets.to_numpy(), values, asked.column("a").to_numpy(), asked.column("b").to_numpy()) if asked.num_rows else np.zeros(0, bool)
        return asked.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    tasks = _tasks(pairs) if n_pairs > 1000 else 1
    return shipped.repartition(tasks, "low_s", "high_s").groupBy("low_s", "high_s").cogroup(placed.repartition(tasks, "low", "high").groupBy("low", "high")).applyInArrow(compare, "a long, b long")


def _looked_up(rows: DataFrame, table: DataFrame, count: str) -> DataFrame:
    """The inner join of ``rows`` with ``table`` (materialised, one row a shingle) on shingle.

    Shingles of more than HOT_ROWS rows by the column ``count`` are at most one in HOT_ROWS of the rows; they are
    joined where their rows are, so that no task gathers all rows of a frequent shingle.
    """
    hot = broadcast_if_small(table.filter(F.col(count) > HOT_ROWS))
    rest = rows.join(hot.select("shingle"), "shingle", "left_anti").join(table.filter(F.col(count) <= HOT_ROWS), "shingle")
    return rows.join(hot, "shingle").unionByName(rest)


def prefix_pairs(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """(a, b) of sets that may be similar enough and lie in different components of ``grouped`` (node, component); none is left out.

    Shingles are ordered from rare to frequent; ``left`` counts a set's shingles from one on, itself
    included. Of two sets that share 3/7 of the sum of their sizes, the first common shingle has that
    many left in both. A shingle of one set alone is never common, and comes before all others.
    """
    shingles = sets.select("id", "n", F.explode("shingles").alias("shingle"))
    times = stored(shingles.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1"))
    from_last = W.partitionBy("id").orderBy(F.col("times").desc(), F.col("shingle").desc())
    first = _looked_up(shingles, times, "times").withColumn("left", F.row_number().over(from_last)).filter("4 * left >= 3 * n").select("shingle", "id", "n", "left")
    component = F.coalesce("component", "id")
    known = grouped.select(F.col("node").alias("id"), "component")
    of = sets.select("id").join(known, "id", "left").select("id", component.alias("component"))
    of = stored(of.join(of.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size"))
    first = stored(first.join(broadcast_if_small(of), "id"))
    # shingles of several components, with the largest of these
    mixed = first.groupBy("shingle").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("size", "component")).alias("top"))
    mixed = stored(mixed.filter("low != high").select("shingle", "rows", F.col("top.component").alias("top")))
    met = stored(_looked_up(first, mixed, "rows").select("shingle", "id", "n", "left", "component", "top", "rows"))
    # the pairs of a frequent shingle are a grid of cells, each with at most some HOT_ROWS rows of either side
    aside = stored(met.filter((F.col("rows") > HOT_ROWS) & (F.col("component") != F.col("top"))).groupBy("shingle").agg(F.ceil(F.count("*") / HOT_ROWS).alias("across")))
    met = met.join(broadcast_if_small(aside), "shingle", "left").withColumn("across", F.coalesce("across", F.lit(1).cast("long"))).withColumn("down", F.ceil(F.col("rows") / HOT_ROWS))
    dealt = lambda c: F.pmod(F.xxhash64(F.lit(37), "id"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    x = met.filter("component != top").select("shingle", dealt("across").alias("i"), each("down").alias("j"), "top", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "left", "component")))
    y = met.select("shingle", each("across").alias("i"), dealt("down").alias("j"), *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "left", "component")))
    tasks, cell = _tasks(sets), ["shingle", "i", "j"]
    pairs = x.repartition(tasks, *cell).join(y.repartition(tasks, *cell).hint("merge"), cell).filter("component_x != component_y and 7 * least(left_x, left_y) >= 3 * (n_x + n_y) and (component_y = top or id_x < id_y)")
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    coded = stored(signatures(docs, text_col, id_col))
    filled = coded.filter("n > 0 and id is not null")
    reps = filled.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    scanned = stored(candidates(reps, coded.count()))
    found, marked = scanned.filter("a != b"), scanned.filter("a = b").select(F.col("a").alias("id"))
    ids = stored(marked.unionAll(found.select(F.col("a").alias("id"))).unionAll(found.select(F.col("b").alias("id"))).distinct())
    sets = stored(sets_of(docs, ids, text_col, id_col))
    set_bytes = 8 * (sets.agg(F.sum("n")).first()[0] or 0)
    # each row's best partner first
    both = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "agree").unionAll(found.select(F.col("b").alias("x"), F.col("a").alias("y"), "agree"))
    best = both.groupBy("x").agg(F.max(F.struct("agree", (-F.col("y")).alias("minus"))).alias("top")).select("x", (-F.col("top.minus")).alias("y"))
    first = stored(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    grouped = stored(components(confirm(first, sets, first.count(), set_bytes)))

    def joined(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
        """Components with the links of ``pairs``, which are materialised."""
        if not (n := pairs.count()):
            return grouped
        links = stored(confirm(pairs, sets, n, set_bytes))
        if links.isEmpty():
            return grouped
        known = grouped.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(components(links.unionAll(known)))

    # then pairs between different components that weren't looked at
    side = lambda c: grouped.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = found.select("a", "b").join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    grouped = joined(stored(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")), grouped)
    final = grouped
    if not marked.isEmpty():
        final = joined(stored(prefix_pairs(sets.join(broadcast_if_small(marked), "id", "left_semi"), grouped)), grouped)
    # only sets of two or more documents need their representative looked up
    classes = stored(filled.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    out = coded.select("id", "n", "f1", "f2").join(broadcast_if_small(classes), ["f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(broadcast_if_small(final.withColumnRenamed("node", "rep")), "rep", "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the smallest id of each component."""
    dropped = stored(near_groups(docs, text_col, id_col).filter("not kept").select("doc_id").distinct())
    return without_ids(docs, dropped, id_col)
