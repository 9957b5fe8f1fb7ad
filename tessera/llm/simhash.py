"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Every document gets a 64-bit SimHash of its word shingles. Two fingerprints are linked if they differ in at
most `radius` bits. Candidates come from a covering family of bit masks: each bit position i gets a non-zero
vector phi(i) of radius + 1 bits, and table v (one for each non-zero v) keeps the positions with an odd number
of ones in v & phi(i). Up to `radius` differing positions span at most a radius-dimensional space, so some
non-zero v is orthogonal to all of them: that table drops every differing bit, and the pair meets there. No
pair within the radius is missed, whatever the data.

Work runs on distinct fingerprints, so exact copies cost one row. A table's bucket is searched breadth first
inside one task and gives a spanning forest (fewer rows than the bucket has), never all its pairs. A bucket
over `bucket_rows` goes on to the next level, where a further covering family splits it; a pair within the radius still
meets at every level. After the last one, a bucket that is still larger is cut into blocks, and each pair of blocks is
searched by a task of its own. Links then become components by alternating star contraction on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import block_pairs, hold_batches, materialise, partitions_for, slices, string_bytes

SEED = 42  # fixed value: the seed of XXH64 over a shingle
LEVELS = 3


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of one text's bytes as an unsigned integer; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of every row; a null text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = string_bytes(batch.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                found = np.array([fingerprint(raw[a:b], width) for a, b in zip(at, at[1:], strict=False)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    hold_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, seed: int) -> list[int]:
    """The kept bits of each table, as signed 64-bit numbers, for one seeded map of positions to vectors."""
    vectors = np.resize(np.arange(1, 2 << radius), 64)  # every vector about equally often
    vectors = np.random.Generator(np.random.PCG64(seed)).permutation(vectors)
    masks = [sum(1 << i for i, x in enumerate(vectors.tolist()) if (x & v).bit_count() & 1) for v in range(1, 2 << radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of every component of distinct unsigned points; lone points give none."""
    points = np.sort(points)
    left, members, roots = points, [], []
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                members.append(found)
                roots.append(np.full(len(found), root))
                frontier.extend(found)
    if not members:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(members), np.concatenate(roots)


def _search(radius: int, most: int | None):
    """Reads rows (key, fp) sorted by key; gives links (a, b, null) and, of larger buckets, rows (null, fp, key)."""

    def links(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        twos = starts[sizes == 2]
        a, b = points[twos], points[twos + 1]
        near = np.bitwise_count(a ^ b) <= radius
        members, roots = [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            x, y = spanning_forest(points[s:e], radius)
            members.append(x)
            roots.append(y)
        return np.concatenate(members), np.concatenate(roots)

    def batch_of(a, b, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a, b, key], ["a", "b", "key"])

    def linked(members: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        return batch_of(pa.array(members.view(np.int64)), pa.array(roots.view(np.int64)), pa.nulls(len(members), pa.int64()))

    def deferred(points: np.ndarray, key: int) -> pa.RecordBatch:
        return batch_of(pa.nulls(len(points), pa.int64()), pa.array(points.view(np.int64)), pa.array(np.full(len(points), key, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False  # the bucket that may go on in the next batch

        def close():
            if held and not over and sum(map(len, held)) > 1:
                points = np.concatenate(held)
                yield linked(*links(points, np.array([len(points)])))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, points = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            head = cuts[0] if len(cuts) else len(keys)
            if key is not None and keys[0] != key:
                yield from close()
                key, held, over = None, [], False
            if key is None:
                key = int(keys[0])
            held.append(points[:head])
            if most is not None and (over or sum(map(len, held)) > most):
                for x in held:
                    yield deferred(x, key)
                held, over = [], True
            if len(cuts):
                yield from close()
                tail = cuts[-1]
                if tail > head:
                    sizes = np.diff(cuts)
                    middle = points[head:tail]
                    large = sizes > most if most is not None else np.zeros(len(sizes), bool)
                    for i in np.flatnonzero(large).tolist():
                        yield deferred(points[cuts[i] : cuts[i + 1]], int(keys[cuts[i]]))
                    if large.any():
                        middle, sizes = middle[np.repeat(~large, sizes)], sizes[~large]
                    yield linked(*links(middle, sizes))
                key, held, over = int(keys[-1]), [points[tail:]], False
                if most is not None and len(held[0]) > most:
                    yield deferred(held[0], key)
                    held, over = [], True
        yield from close()

    return run


def links(distinct: DataFrame, radius: int, bucket_rows: int = 1 << 16) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column fp, distinct) that chains of steps within radius connect."""
    rows, out = distinct.select(F.lit(0).cast("long").alias("key"), "fp"), None
    hold_batches(distinct.sparkSession)
    for level in range(LEVELS):
        masks = covering_masks(radius, seed=level + 1)
        tables = F.explode(F.array([F.xxhash64("key", F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)]))
        keyed = rows.select(tables.alias("key"), "fp")
        dealt = keyed.repartition(partitions_for(rows, len(masks)), "key").sortWithinPartitions("key")
        found = materialise(dealt.mapInArrow(_search(radius, bucket_rows), "a long, b long, key long"), "simhash-links")
        own = found.where("key is null").select("a", "b")
        out = own if out is None else out.union(own)
        rows = found.where("key is not null").select("key", F.col("b").alias("fp"))
        if rows.isEmpty():
            return out.distinct()
    pairs = block_pairs(rows, "key", "fp", F.lit(1), bucket_rows).select(F.xxhash64("key", "pair").alias("key"), "fp")
    dealt = pairs.repartition(partitions_for(pairs), "key").sortWithinPartitions("key")
    return out.union(dealt.mapInArrow(_search(radius, None), "a long, b long, key long").select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node of its component.

    Alternating star contraction: a large star ties each node's larger neighbours to its smallest neighbour, a
    small star its smaller ones; both use a grouped minimum and a join. The minima are a table of their own, so that a
    hub with very many links reaches the join by a plain shuffle, which Spark splits. Each round is a table in the shared folder; the
    driver sees a count and a checksum.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "components-low")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(documents: DataFrame, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Null or empty texts have fingerprint zero, which links like any other. Rows with a null id keep their row; such an id
    is never the component_id unless all ids of the component are null. Repeated rows stay. An empty table gives no rows.
    Extra columns are ignored, whatever their names.
    """
    marks = materialise(fingerprints(documents, width, id_col, text_col), "simhash")
    smallest = marks.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
    roots = materialise(components(links(smallest.select("fp"), radius)), "simhash-components")
    of_root = roots.join(smallest, roots.node == smallest.fp).groupBy("root").agg(F.min("low").alias("low"))
    linked = roots.join(of_root, "root").select(F.col("node").alias("fp"), F.col("low").alias("far"))
    # rows alone with their fingerprint and without a link are their own group; as a table of its own, the rest leaves the
    # last join two plain shuffles, so a fingerprint that very many rows share can be split
    groups = smallest.join(linked, "fp", "left").where("rows > 1 or far is not null").select("fp", F.coalesce("far", "low").alias("group"))
    groups = materialise(groups, "simhash-groups")
    return marks.join(groups, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("group", "id").alias("component_id"))


def one_of_each_group(documents: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """The documents that are the smallest id of their group, with all columns; rows with a null id all stay."""
    groups = near_duplicates(documents, width, radius)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
